"""Sentences with known results, which queries let the rows of a given table say, and how their names vary by the row."""

import re

#: Names in the sentences that get the row's number, in the sentences and in what they must give alike.
VARIED = ["Upstash Redis", "self-hosted PostgreSQL", "Neon", "kanban", "React", "Hono", "Turso", "Redis", "Groq", "Bun", "Tailwind", "Bootstrap", "Rust", "MongoDB", "Ada", "Oslo", "Rome", "Helix", "Vim", "Node", "weekly", "Supabase", "Fly", "temp1234", "8080", "Material UI", "ThinkPad"]


def varied(text: str) -> str:
    """The text with `{n}` after each of these names."""
    return re.sub("|".join(map(re.escape, sorted(VARIED, key=len, reverse=True))), lambda m: m[0] + ("{n}" if m[0][-1].isdigit() else " {n}"), text)


SENTENCES = [
    "ok", "okay", "sounds good to me", "thanks a lot", "cool", "lgtm", "yes", "+", "Deploy the new version to AWS Lambda", "What database do we use?",
    "What is my name", "Tell me what database we use", "Can you explain how the cache works", "The reason why we chose PostgreSQL is reliability",
    "Where we deploy is AWS Lambda", "I prefer TypeScript", "What we decided is to use Neon", "how much memory", "what's up", "is not", "Which web framework is best",
    "haha", "lol nice", "Maybe we could try Rust", "I think it works", "Actually, we use PostgreSQL", "No, use Turso", "The error is 401", "I'm debugging auth",
    "Working on the checkout flow", "My favourite colour is green", "Hello world! This is a test string.", "It's built. Now deploy; \"quoted\" text", "a=b", "  ", "",
]
USES = ["P uses Neon for database", "The team uses kanban", "App is using React", "It will use Hono", "Nothing here"]
LISTS = ["It uses Cloudflare Workers with Hono, Turso as the database, Upstash Redis for caching, and Groq for summarization.", "Gateway runs on Bun and Redis", "It uses Bun"]
PREFERENCES = [
    "I prefer Tailwind over Bootstrap", "I would rather use Rust than Go", "My favorite colour is green", "My preferred database is Neon", "I love red", "I really like TypeScript",
    "I hate MongoDB", "I don't like coffee", "I love blue now", "I love this response", "I like how you explained that", "I love this", "prefer dark mode",
]
STATEMENTS = ["P's architecture is event-driven microservices", "Team's goal is shipping weekly", "My name is Ada", "The database is Neon", "note: port = 8080", "The goal is growth", "I live in Oslo", "I'm from Rome", "I am building an AI Memory Gateway called P", "We are tired"]
SWITCHES = ["We switched P to Turso for the database.", "switched to Redis", "I switched it to Bun", "We changed our mind"]
CORRECTIONS = ["P changed from Neon to self-hosted PostgreSQL", "The database was changed to self-hosted PostgreSQL", "App now uses Bun instead of Node", "I changed my editor from Vim to Helix", "The plan changed to weekly", "Nothing changed"]
REVOCATIONS = ["The temporary password was reset; ignore temp1234", "Ignore the previous password", "That token is no longer valid", "The key has been revoked", "forget the old address", "I forgot it"]
LABELLED = ["[decision] Ship on Friday", "Goal: grow fast", "constraint: never log keys", "We need to ship soon", "Deployed v2 to production", "Never store secrets", "port: 8080", "hosting = Fly", "random words here"]
SCRIPT = [
    ("a", ["P uses Neon for database", "Actually, P uses self-hosted PostgreSQL", "I love red", "I love blue now", "The temporary password is temp1234", "The temporary password was reset; ignore temp1234"]),
    ("b", ["I prefer dark theme", "Actually, I prefer light theme now", "I prefer light theme", "I prefer light themes", "ok", "thanks a lot", "What database do we use?"]),
    ("c", ["P uses Neon for its database.", "We switched P to Turso for the database."]),
]
#: What the fold must do with SCRIPT: user, place in order, action.
SCRIPT_ACTIONS = [("a", 1, "create"), ("a", 2, "supersede"), ("a", 3, "create"), ("a", 4, "supersede"), ("a", 5, "create"), ("a", 6, "revoke"), ("b", 1, "create"), ("b", 2, "supersede"), ("b", 3, "supersede"), ("b", 4, "merge"), ("c", 1, "create"), ("c", 2, "supersede")]
#: All sentences of one message each, and what candidates they must give: place, content, type, topic, whether it corrects, subject, predicate, value, scope.
SAID = USES + LISTS + PREFERENCES + STATEMENTS + SWITCHES + CORRECTIONS + REVOCATIONS + LABELLED
CANDIDATES = [
    (0, "Database: Neon for database", "decision", "project.database", False, "P", "database", "Neon for database", "project"),
    (1, "Workflow: kanban", "fact", "project.workflow", False, "team", "workflow", "kanban", "project"),
    (2, "Frontend: React", "decision", "project.frontend", False, "App", "frontend", "React", "project"),
    (3, "Framework: Hono", "decision", "project.framework", False, "It", "framework", "Hono", "project"),
    (5, "Runtime: Cloudflare Workers", "decision", "project.runtime", False, "project", "runtime", "Cloudflare Workers", "project"),
    (5, "Framework: Hono", "decision", "project.framework", False, "project", "framework", "Hono", "project"),
    (5, "Database: Turso", "decision", "project.database", False, "project", "database", "Turso", "project"),
    (5, "Caching: Upstash Redis", "decision", "project.caching", False, "project", "caching", "Upstash Redis", "project"),
    (5, "Summarization: Groq", "decision", "project.summarization", False, "project", "summarization", "Groq", "project"),
    (6, "Runtime: Bun", "decision", "project.runtime", False, "Gateway", "runtime", "Bun", "project"),
    (6, "Cache: Redis", "decision", "project.cache", False, "Gateway", "cache", "Redis", "project"),
    (7, "Runtime: Bun", "decision", "project.runtime", False, "It", "runtime", "Bun", "project"),
    (8, "Tailwind", "preference", "preference:ui_library", False, "user", "ui_library", "Tailwind", "user"),
    (9, "Rust", "preference", "preference:language", False, "user", "language", "Rust", "user"),
    (10, "green", "preference", "preference:favorite_color", False, "user", "favorite_color", "green", "user"),
    (11, "Neon", "preference", "preference:preferred_database", False, "user", "preferred_database", "Neon", "user"),
    (12, "red", "preference", "preference:favorite_color", False, "user", "favorite_color", "red", "user"),
    (13, "TypeScript", "preference", "preference:language", False, "user", "language", "TypeScript", "user"),
    (14, "MongoDB", "preference", "preference:disliked_database", False, "user", "disliked_database", "MongoDB", "user"),
    (15, "coffee", "preference", "preference:disliked_coffee", False, "user", "disliked_coffee", "coffee", "user"),
    (16, "blue", "preference", "preference:favorite_color", False, "user", "favorite_color", "blue", "user"),
    (20, "dark mode", "preference", "preference:theme", False, "user", "theme", "dark mode", "user"),
    (21, "Architecture: event-driven microservices", "architecture", "project.architecture", False, "P", "architecture", "event-driven microservices", "project"),
    (22, "Goal: shipping weekly", "goal", "project.goal", False, "Team", "goal", "shipping weekly", "project"),
    (23, "Name: Ada", "fact", "user.name", False, "user", "name", "Ada", "user"),
    (24, "Database: Neon", "decision", "project.database", False, "database", "database", "Neon", "project"),
    (25, "Port: 8080", "fact", "project.port", False, "port", "port", "8080", "project"),
    (26, "Goal: growth", "goal", "project.goal", False, "goal", "goal", "growth", "project"),
    (27, "Location: Oslo", "fact", "user.location", False, "user", "location", "Oslo", "user"),
    (28, "Project: from Rome", "fact", "project.name", False, "from Rome", "project", "from Rome", "project"),
    (29, "Project: P", "fact", "project.name", False, "P", "project", "P", "project"),
    (30, "Project: tired", "fact", "project.name", False, "tired", "project", "tired", "project"),
    (31, "Database: Turso", "decision", "project.database", True, "P", "database", "Turso", "project"),
    (32, "Cache: Redis", "decision", "project.cache", True, "project", "cache", "Redis", "project"),
    (33, "Runtime: Bun", "decision", "project.runtime", True, "project", "runtime", "Bun", "project"),
    (35, "Database: self-hosted PostgreSQL", "decision", "project.database", True, "P", "database", "self-hosted PostgreSQL", "project"),
    (36, "Database: self-hosted PostgreSQL", "decision", "project.database", True, "database", "database", "self-hosted PostgreSQL", "project"),
    (37, "Runtime: Bun", "fact", "project.runtime", True, "App", "runtime", "Bun", "project"),
    (38, "Preference: Helix", "fact", "project.preference", True, "editor", "preference", "Helix", "project"),
    (39, "Plan: weekly", "fact", "project.plan", True, "plan", "plan", "weekly", "project"),
    (41, "REVOKE: temporary password", "fact", "__revocation__", False, "project", "revoke", "temporary password", "project"),
    (42, "REVOKE: password", "fact", "__revocation__", False, "project", "revoke", "password", "project"),
    (43, "REVOKE: token", "fact", "__revocation__", False, "project", "revoke", "token", "project"),
    (44, "REVOKE: key", "fact", "__revocation__", False, "project", "revoke", "key", "project"),
    (45, "REVOKE: address", "fact", "__revocation__", False, "project", "revoke", "address", "project"),
    (47, "Ship on Friday", "decision", "decision:ship_friday", False, "project", "decision", "Ship on Friday", "project"),
    (48, "Goal: grow fast", "goal", "project.goal", False, "Goal", "Goal", "grow fast", "project"),
    (49, "Constraint: never log keys", "fact", "project.constraint", False, "constraint", "constraint", "never log keys", "project"),
    (50, "ship soon", "goal", "goal:ship_soon", False, "project", "goal", "ship soon", "project"),
    (51, "v2 to production", "important_event", "important_event:v2_production", False, "project", "important_event", "v2 to production", "project"),
    (52, "store secrets", "constraint", "constraint:store_secrets", False, "project", "constraint", "store secrets", "project"),
    (53, "Port: 8080", "fact", "project.port", False, "port", "port", "8080", "project"),
    (54, "Hosting: Fly", "decision", "project.hosting", False, "hosting", "hosting", "Fly", "project"),
]
ANSWERS = [
    ("u1", 'Sure:\n```json\n[{"entity":"user","attribute":"db","value":"Neon","type":"FACT","state":"current","confidence":0.9}]\n```'),
    ("u1", '[{"entity":"P","attribute":"Programming Language","value":"Rust","type":"decision","confidence":0.2}]'),
    ("u2", '[{"entity":"P","attribute":"cache","value":" Redis ","type":"decision","confidence":7,"metadata":{"over":"KV"}}]'),
    ("u2", "no facts"),
]
#: Members of stack clusters: user, id, predicate, topic, scope, value, confidence.
STACK = [
    ("s", 1, "language", "preference:language", "user", "TypeScript", 0.9), ("s", 2, "database", "user.database", "user", "Neon", 0.8), ("s", 3, "runtime", "user.runtime", "user", "Cloudflare Workers", 0.85),
    ("s", 4, "framework", "user.framework", "user", "Hono", 0.7), ("s", 5, "language", "user.language", "user", "JavaScript", 0.4), ("t", 1, "language", "project.language", "project", "Go", 0.9),
    ("t", 2, "", "project.hosting", "project", "vercel", 0.6), ("t", 3, "notes", "project.notes", "project", "runs postgres", 0.5), ("t", 4, "favorite_color", "preference:favorite_color", "user", "red", 0.9), ("v", 1, "language", "user.language", "user", "C", 0.9),
]

#: Sentences of the richer extractors and what they must give: place, kind, attribute, value, state, confidence.
RICH = [
    "My name is Ada Stone. I use Cloudflare Workers.", "I used to use Supabase but now I use Neon Postgres.", "I don't like MongoDB anymore, I stopped using it last year.", "I prefer tea", "I avoid Java",
    "I am not a fan of PHP", "my laptop is a ThinkPad", "My favorite color is green", "I am a freelance developer", "I want to use GraphQL for my next project.", "I plan to migrate to Bun.",
    "I might switch to Deno later.", "I decided to use Hono for routing.", "I'm testing Rust", "I am 19 years old", "I have a headache", "If it works then I will use Bun", "We're using Kafka without Zookeeper",
    "I prefer Material UI over Ant Design.",
]
RICH_FACTS = [
    (0, "identity", "name", "Ada Stone", "current", 1.0), (0, "usage", "technology", "Cloudflare Workers", "current", 0.98), (1, "past_usage", "technology", "Supabase", "past", 0.95),
    (1, "usage", "technology", "Neon Postgres", "current", 0.98), (2, "dislike", "dislike", "MongoDB", "current", 0.95), (3, "preference", "preference", "tea", "current", 0.98), (4, "dislike", "dislike", "Java", "current", 0.92),
    (5, "identity", "location", "not a fan of PHP", "current", 1.0), (5, "dislike", "dislike", "PHP", "current", 0.85), (6, "ownership", "laptop", "a ThinkPad", "current", 0.95),
    (7, "ownership", "favorite color", "green", "current", 0.95), (8, "identity", "occupation", "a freelance developer", "current", 0.95), (9, "goal", "goal", "use GraphQL for my next project", "planned", 0.95),
    (10, "plan", "plan", "migrate to Bun", "planned", 0.95), (11, "possible_plan", "plan", "switch to Deno later", "possible", 0.7), (12, "decision", "decision", "use Hono for routing", "current", 0.95),
    (13, "identity", "location", "testing Rust", "current", 1.0), (13, "temporary", "temporary_state", "Rust", "current", 0.4), (14, "identity", "age", "19", "current", 1.0), (16, "conditional", "plan", "Bun", "conditional", 0.6),
    (17, "usage", "technology", "Kafka without Zookeeper", "stopped", 0.95), (18, "preference", "ui_library", "Material UI", "current", 0.98),
]
#: Texts at the memory gate: whether a model is called, confidence, reason, kinds.
GATES = [
    ("hey there!", False, 0.99, "greeting_or_acknowledgement", ""), ("Hello.", False, 0.99, "greeting_or_acknowledgement", ""), ("ok", False, 0.99, "low_info", ""), ("thanks!", False, 0.99, "low_info", ""),
    ("Ok great thanks", False, 0.99, "low_info", ""), ("nope", False, 0.99, "low_info", ""), ("What is the capital of France?", False, 0.99, "pure_question", ""),
    ("I use Cloudflare Workers with D1 for storage.", False, 0.95, "local_patterns", "usage"), ("I used to use Supabase but now I use Neon Postgres.", False, 0.95, "local_patterns", "past_usage,usage"),
    ("I am Ada Stone", True, 0.5, "ambiguous_semantic", "ambiguous"), ("haha", False, 0.85, "no_memory_keywords", ""), ("lgtm", False, 0.85, "no_memory_keywords", ""),
    ("Tell me what database we use", True, 0.5, "ambiguous_semantic", "ambiguous"), ("My favorite color is green", False, 0.95, "local_patterns", "favorite"), ("", False, 0.99, "empty", ""),
]
ROUTED = ["hey there, thanks!", "I prefer Material UI over Ant Design.", "I am Ada Stone", "The sky looked odd from here"]
ROUTES = [(0, "skip", 0.85), (1, "local", 0.95), (2, "local", 0.7), (3, "local", 0.3)]
