"""Word lists, patterns and constants of the memory semantics.

Fixed values: all of them must equal the published behaviour of the system whose results are matched. Patterns are written
with the ASCII word boundary `\\b`; `text.pattern` turns it into a form that Java's Unicode-aware engine reads alike.
"""

from __future__ import annotations

LOW_INFO = [
    "ok", "okay", "k", "kk", "yes", "yep", "yeah", "yup", "no", "nope", "nah", "thanks", "thank you", "thx", "ty", "continue", "go on", "go ahead",
    "run it", "do that", "do it", "sure", "sure thing", "for sure", "cool", "got it", "got", "gotcha", "sounds", "sounds good", "sounds good to me",
    "that works", "works for me", "fine by me", "makes sense", "that makes sense", "please", "pls", "lgtm", "sgtm", "ack", "roger", "copy", "aye",
    "hm", "hmm", "huh", "haha", "lol", "great", "nice", "perfect", "awesome", "good", "fine", "right", "correct", "agreed", "absolutely", "totally",
    "alright", "understood", "i see", "no worries", "no problem", "np", "thanks a lot", "thank you very much", "much appreciated", "on it", "will do",
    "go for it", "keep going", "let us continue", "+", "++", "what", "why", "how", "who", "when", "where", "which",
]

STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "when", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "once",
    "here", "there", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "i", "me", "my", "we", "our", "you", "your", "he", "she", "it",
    "they", "them", "what", "which", "who", "whom", "where", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing",
]

NOISE_WORDS = [
    "haha", "lol", "ok", "okay", "k", "kk", "yes", "yeah", "yep", "yup", "no", "nope", "nah", "thanks", "thank", "thx", "ty", "cool", "great", "nice",
    "good", "fine", "sure", "got", "gotcha", "lgtm", "ack", "right", "hm", "hmm", "huh", "please", "pls", "perfect", "awesome", "agreed", "alright",
    "understood", "works", "sounds",
]

QUESTION_WORDS = ["what", "why", "how", "who", "whom", "whose", "when", "where", "which"]

INVALID_KEYS = [
    "what", "when", "where", "which", "who", "whom", "whose", "why", "how", "is", "are", "was", "were", "do", "does", "did", "can", "could", "will",
    "would", "should", "shall", "have", "has", "had", "may", "might",
]

PREFERENCE_NOISE = [
    "this", "that", "these", "those", "it", "response", "answer", "reply", "message", "error", "bug", "result", "output", "suggestion", "idea",
    "solution", "explanation",
]

DB = [
    "postgres", "postgresql", "mysql", "mariadb", "sqlite", "mongodb", "mongo", "redis", "valkey", "dynamodb", "d1", "turso", "libsql", "neon",
    "supabase", "planetscale", "cockroachdb", "cockroach", "pglite", "pinecone", "weaviate", "qdrant", "milvus", "faiss", "elasticsearch",
    "opensearch", "clickhouse", "upstash", "database", "db",
]
UI = ["tailwind", "mui", "shadcn", "bootstrap", "chakra", "antd"]
FRONTEND = ["react", "next", "next.js", "vue", "nuxt", "svelte", "sveltekit", "astro", "solid", "angular", "remix", "tanstack", "tanstack start"]
LANGUAGE = ["typescript", "javascript", "python", "go", "golang", "rust", "java", "kotlin", "swift", "c", "c++", "csharp", "php", "ruby", "dart", "lua"]
THEME = ["dark", "light", "dark mode", "light mode", "dark theme", "light theme"]
WORKFLOW = ["agile", "scrum", "kanban", "waterfall", "sprint", "workflow"]
RUNTIME = ["cloudflare", "workers", "deno", "node", "nodejs", "bun", "lambda", "vercel", "netlify", "edge"]
FRAMEWORK = ["hono", "express", "fastify", "flask", "django", "fastapi", "spring", "laravel", "elysia", "bun", "node", "node.js", "deno"]
COLOR = [
    "red", "blue", "green", "yellow", "orange", "purple", "pink", "black", "white", "gray", "grey", "brown", "cyan", "magenta", "violet", "indigo",
    "teal", "navy", "maroon", "beige", "gold", "silver",
]

#: Ordered preference domains: words, parts of the text, exact words, attribute.
DOMAINS = [
    (UI, ["ui library"], ["ui"], "ui_library"),
    (FRONTEND, ["frontend", "framework"], [], "frontend_framework"),
    (LANGUAGE, ["language"], [], "language"),
    (THEME, ["theme", "mode"], [], "theme"),
    (DB, ["database", "db"], [], "database"),
    (WORKFLOW, [], [], "workflow"),
    (RUNTIME, ["runtime", "cloudflare workers"], [], "runtime"),
    (FRAMEWORK, ["framework"], [], "framework"),
    (COLOR, [], ["color"], "favorite_color"),
]

#: Ordered attribute patterns of a used value.
VALUE_ATTRIBUTES = [
    (r"\b(turso|neon|postgres|postgresql|supabase|mysql|sqlite|libsql|mongodb|mariadb|dynamodb|cockroach|database|db)\b", "database"),
    (r"\b(upstash|redis|memcached|cloudflare kv|kv store|cache)\b", "cache"),
    (r"\b(cloudflare r2|r2|s3|gcs|azure blob|minio|object storage|storage)\b", "storage"),
    (r"\b(embedding|embeddings|pgvector|vector|semantic retrieval|semantic)\b", "semantic_retrieval"),
    (r"\b(groq|openai|anthropic|claude|gpt|llama|mistral|gemini|mixtral|summariz)\b", "summarization"),
    (r"\b(hono|next|nextjs|express|fastify|nuxt|sveltekit|flask|django|spring|rails|fastapi)\b", "framework"),
    (r"\b(cloudflare workers|cloudflare|workers|deno|node|nodejs|bun|lambda|aws lambda|vercel|netlify|edge)\b", "runtime"),
]

#: The same for the value of a switch.
SWITCH_ATTRIBUTES = [
    (r"\b(turso|neon|postgres|postgresql|supabase|mysql|sqlite|libsql|mongodb|mariadb|dynamodb|database|db)\b", "database"),
    (r"\b(upstash|redis|memcached)\b", "cache"),
    (r"\b(cloudflare r2|r2|s3|gcs|object storage|storage)\b", "storage"),
    (r"\b(embedding|semantic|vector|retrieval)\b", "semantic_retrieval"),
    (r"\b(groq|openai|anthropic|gpt|llama|summariz)\b", "summarization"),
    (r"\b(hono|next|express|fastify|react|vue)\b", "framework"),
    (r"\b(cloudflare workers|deno|node|bun|lambda|vercel)\b", "runtime"),
]

#: Ordered attribute patterns of a purpose ("... for <purpose>").
PURPOSE_ATTRIBUTES = [
    (r"\b(database|db|storage\b|data)\b", "database"),
    (r"\b(cache|redis|kv)\b", "cache"),
    (r"\b(object storage|storage|files)\b", "storage"),
    (r"\b(semantic|embedding|retrieval|vector)\b", "semantic_retrieval"),
    (r"\b(summariz|llm|model|ai|generation|completion)\b", "summarization"),
    (r"\b(framework|web framework)\b", "framework"),
    (r"\b(runtime|hosting|deploy|platform|server|edge)\b", "runtime"),
    (r"\b(api|interface|client|sdk)\b", "technology"),
]

SPECULATIVE = r"\b(might|maybe|perhaps|could|possibly|probably|i think|we might|considering|not sure|unsure|tentative)\b"
DECISION = r"\b(decided|decision|we will|we'll|we are using|we're using|chose|chosen|switched to|use .+ for)\b"
CORRECTION = r"\b(actually|correction|not\b.+\bbut\b|instead of|no longer|changed (to|from)|switch(?:ed)? to)\b"
CONTEXT_MARKERS = r"\b(currently|right now|at the moment|in progress|ongoing|debugging|working on|current (task|error|issue|bug)|the (error|issue|bug) is|is broken|temporarily|for now)\b"
HISTORY = r"\b(used to|previously|before|old|former|was|were|history|superseded|changed from)\b"

#: Ordered context keys of a transient candidate; the last is the default.
CONTEXT_KEYS = [
    (r"\b(debug|debugging)\b", "active_debugging_context"),
    (r"\b(error|bug|exception|failed|failure)\b", "current_error"),
    (r"\b(task|working on|doing|implementing|fixing|building now)\b", "current_task"),
]
TTL_SECONDS = {"current_error": 3600}
TTL_DEFAULT = 7200

#: Question patterns; the first of each pair has look-ahead, which some engines lack.
ENDS_WITH_QUESTION = r"\?\s*[\"']?\s*$"
QUESTIONS = [
    r"^\s*(?:what|when|where|why|who|whom|whose|how)(?:'s|'re|'d)?\s+(?:is|are|am|was|were|do|does|did|can|could|will|would|should|shall|have|has|had|may|might|must)\b",
    r"^\s*(?:what|when|where|why|who|how)'s\b",
    r"^\s*how\s+(?:much|many|long|often|fast|far|come)\b",
    r"^\s*(?:what|which)\s+(?!(?:we|i|you|they|he|she|it)\b)(?:[a-z0-9_-]+\s+){1,3}(?:is|are|am|was|were|do|does|did|can|could|will|would|should|shall|have|has|had)\b",
    r"^\s*(?:is|are|am|was|were|do|does|did|can|could|would|should|shall)\s+(?!(?:not\b|n't\b))(?:we|you|they|he|she|it|i|there|this|that|the|a|an|[a-z0-9_-]+)\b",
    r"^\s*will\s+(?:we|you|they|he|she|it|i|there|this|that|the|a|an)\b",
    r"^\s*(?:have|had)\s+(?:we|you|they|i)\b",
    r"^\s*has\s+(?:the|it|this|that|anyone|everyone|[a-z0-9_-]+)\b",
    r"^\s*may\s+(?:i|we)\b",
    r"^\s*(?:can\s+you\s+|could\s+you\s+|please\s+)?(?:tell\s+me|remind\s+me|show\s+me|explain|let\s+me\s+know|find\s+out|check\s+if|check\s+whether)\b",
]

TYPE_IMPORTANCE = {
    "decision": 0.9, "constraint": 0.88, "goal": 0.8, "architecture": 0.82, "preference": 0.7, "fact": 0.65, "important_event": 0.75,
    "active_task": 0.72, "temporary_state": 0.3,
}
DURABLE_TYPES = ["fact", "decision", "constraint", "preference", "goal", "architecture", "important_event"]

CORRECTION_PREFIX = r"^\s*(?:actually[,:]?\s+|correction[,:]?\s+|no[,:]?\s+|wait[,:]?\s+|on\s+second\s+thought[,:]?\s+|to\s+clarify[,:]?\s+|i\s+meant[,:]?\s+|let\s+me\s+correct\s+that[,:]?\s+|scratch\s+that[,:]?\s+)"

#: Ordered corrections: pattern, groups of (target, old, new); 0: none.
CORRECTIONS = [
    (r"^(?:the\s+)?([A-Za-z][\w\s/-]{0,30}?)\s+changed\s+from\s+(.+?)\s+to\s+(.+?)\s*[.!]?$", (1, 2, 3)),
    (r"^(?:the\s+)?([A-Za-z][\w\s/-]{0,30}?)\s+(?:now\s+)?uses\s+(.+?)\s+instead\s+of\s+(.+?)\s*[.!]?$", (1, 3, 2)),
    (r"^i\s+changed\s+(?:my\s+)?([A-Za-z][\w\s/-]{0,30}?)\s+from\s+(.+?)\s+to\s+(.+?)\s*[.!]?$", (1, 2, 3)),
    (r"^the\s+([A-Za-z][\w\s/-]{0,30}?)\s+was\s+changed\s+to\s+(.+?)\s*[.!]?$", (1, 0, 2)),
    (r"^the\s+([A-Za-z][\w\s/-]{0,30}?)\s+changed\s+to\s+(.+?)\s*[.!]?$", (1, 0, 2)),
]

#: Ordered revocations; group 1 is the target.
REVOCATIONS = [
    r"^(?:the\s+|that\s+|this\s+|temporary\s+|previous\s+|old\s+)?([\w\s/-]+?)\s+was\s+reset\b",
    r"^(?:please\s+)?ignore\s+(?:the\s+)?(?:previous|old|earlier|last)\s+([\w\s/-]+?)\s*[.!]?$",
    r"^(?:the\s+|that\s+|this\s+)?([\w\s/-]+?)\s+(?:is|are)\s+no\s+longer\s+valid\b",
    r"^(?:the\s+)?([\w\s/-]+?)\s+has\s+been\s+revoked\b",
    r"^forget\s+(?:the\s+)?(?:previous|old|earlier|last\s+)?([\w\s/-]*?)\s*[.!]?$",
]
REVOKED_VALUE = r"(?:ignore|instead|forget)\s+(?:it\s+)?(?:the\s+)?(?:old\s+|previous\s+)?[\"']?([A-Za-z0-9][A-Za-z0-9_-]{2,})[\"']?"
COMMON_WORDS = [
    "was", "were", "is", "are", "has", "have", "had", "been", "reset", "ignored", "revoked", "the", "and", "that", "this", "its", "it", "from", "to",
    "for", "with", "now", "previous", "old", "new",
]

BUILDING = r"^\s*(?:i\s+am|i'm|we\s+are|we're|building)\s+(?:building\s+)?(.+?)\s*[.!?]?$"
LOCATIONS = [r"^\s*(?:i\s+live|i\s+stay|i'm\s+based)\s+in\s+(.+?)\s*[.!?]?$", r"^\s*(?:i\s+am\s+from|i'm\s+from)\s+(.+?)\s*[.!?]?$"]
USES = r"^\s*(?:the\s+)?([A-Za-z][\w\s/-]{0,30}?)\s+(?:uses|is\s+using|will\s+use)\s+(.+?)\s*[.!?]?$"
POSSESSIVE = r"^\s*([A-Za-z][\w\s/-]{0,30}?)'s\s+([A-Za-z][\w\s/-]{0,30}?)\s+(?:is|are|was|will\s+be|has\s+been|scheduled\s+for)\s+(.+?)\s*[.!?]?$"
PREFER = r"^\s*(?:i\s+)?(?:prefer|would\s+rather|preference)\b[:\s-]*(.+?)(?:\s+over\s+(.+?)|\s+than\s+(.+?))?\s*[.!?]?$"
FAVORITE = r"^\s*(?:my\s+)?(favorite|favourite|preferred)\s+([A-Za-z][\w\s/-]{0,30}?)\s+(?:is|are|=|:)\s+(.+?)\s*[.!?]?$"
AFFECT = r"^\s*i\s+(?:(?:do\s+not|don't|dont)\s+(?:really\s+)?(like|love|enjoy|prefer)|(?:really\s+)?(love|like|enjoy|adore|hate|dislike))\s+(.+?)\s*[.!?]?$"
THE_IS = r"^\s*(?:(?:temporary\s+detail|note|detail)\s*[:\s-]\s*)?(?:the\s+|my\s+)?([A-Za-z][\w\s/-]{0,35}?)\s*(?:=| is | are | was | will\s+be |:=|:)\s*(.+?)\s*[.!?]?$"
USES_LIST = r"^(.*?)\s+(?:uses|is using|will use|relies on|is built on|runs on)\s+(.+)$"
TRAILING_TIME = r"\s+(?:now|these\s+days|anymore|lately|currently|today|recently)\s*$"
PRONOUN_SUBJECTS = ["it", "this", "that", "the project", "the app", "the application", "the product", "the system", "the platform", "the service", "we", "our", "the gateway", "the tool"]
SWITCHED = [r"^(?:we\s+|i\s+)?(?:have\s+|have\s+we\s+)?switched\s+([\w\s/-]+?)\s+to\s+(.+?)\s*[.!]?$", r"^(?:we\s+|i\s+)?switched\s+to\s+(.+?)\s*[.!]?$"]
SWITCH_PRONOUN = r"^(it|this|that|the\s+project|the\s+app|we|our)$"
SWITCH_TAIL = r"\s+(?:for|as)\s+(?:the|its|our|a|an)?\s*[a-z0-9 _/-]*$"

#: Labels before a colon or in brackets, and the types they name.
LABELS = {
    "fact": "fact", "facts": "fact", "decision": "decision", "decisions": "decision", "constraint": "constraint", "constraints": "constraint",
    "preference": "preference", "preferences": "preference", "goal": "goal", "goals": "goal", "architecture": "architecture",
    "important_event": "important_event", "important event": "important_event", "event": "important_event", "active_task": "active_task",
    "active task": "active_task", "task": "active_task", "todo": "active_task",
}
PREFIX = r"(?s)^\s*(?:\[([a-z_ ]+)\]|([a-z_ ]+)\s*:)\s*(.+)$"
KEY_VALUE = r"^\s*([A-Za-z][\w\s/-]{0,40}?)\s*(?:=| is | are |:=|:)\s*(.+?)\s*$"
DECISION_TEXT = r"^\s*(?:we\s+)?(?:decided(?:\s+to)?|will\s+use|are\s+using|chose|picked|switched(?:\s+production)?\s+to|use)\s+(.+)$"
#: Ordered fallbacks of an unlabelled sentence.
TYPED_TEXT = [
    (r"^\s*(?:(?:do\s+not|don't|never|must\s+not|cannot|can't|constraint)\b[:\s-]*)(.+)$", "constraint"),
    (r"^\s*(?:i\s+)?(?:prefer|would\s+rather|preference)\b[:\s-]*(.+)$", "preference"),
    (r"^\s*(?:goal|objective|we\s+need\s+to|aim\s+to)\b[:\s-]*(.+)$", "goal"),
    (r"^\s*(?:todo|task|working\s+on|next)\b[:\s-]*(.+)$", "active_task"),
    (r"^\s*(?:deployed|shipped|launched|released|incident)\b[:\s-]*(.+)$", "important_event"),
    (r"^\s*(?:architecture|stack|system\s+design)\b[:\s-]*(.+)$", "architecture"),
    (DECISION_TEXT, "decision"),
]
TOPIC_STOP = ["we", "the", "a", "an", "to", "for", "and", "or", "of", "in", "on", "is", "are", "use", "using", "will", "decided", "our", "be"]

#: Fields of a consolidated technology stack, by predicate.
STACK_FIELDS = {
    "language": "language", "preferred_language": "language", "database": "database", "preferred_database": "database", "runtime": "runtime",
    "preferred_runtime": "runtime", "hosting": "runtime", "framework": "framework", "preferred_framework": "framework", "frontend": "frontend",
    "frontend_framework": "frontend", "ui_library": "ui_library", "cache": "cache", "preferred_cache": "cache", "storage": "storage",
    "preferred_storage": "storage", "technology": "technology",
}
STACK_VALUES = [
    (r"\b(typescript|javascript|python|golang|java|ruby|php|swift|kotlin)\b", "language"),
    (r"\b(neon|postgres|postgresql|mysql|sqlite|mongodb|turso|supabase|redis)\b", "database"),
    (r"\b(cloudflare|workers|deno|nodejs|bun|lambda|vercel|netlify)\b", "runtime"),
    (r"\b(hono|express|fastify|next|nuxt|django|flask|fastapi)\b", "framework"),
    (r"\b(tailwind|mui|shadcn|bootstrap|chakra)\b", "ui_library"),
]
STABILITY_SCORES = {"permanent": 1.0, "long-term": 0.85, "short-term": 0.5, "session": 0.25}

SESSION_ID = r"^[A-Za-z0-9_-]{1,128}$"
SESSION_MARKER = r"^\s*___\$\$\(([A-Za-z0-9_-]{1,128})\)\$\$___\s*"

#: Patterns of the richer extractors, each with its attribute, state and confidence; their groups are named below by number.
IDENTITY = [
    (r"^\s*(?:my\s+)?(?:full\s+)?name\s+is\s+(.+?)\s*[.!?]?$", "name", 1.0),
    (r"^\s*(?:i\s+am|i'm|we\s+are|we're)\s+(.+?)\s+years?\s+old\s*[.!?]?$", "age", 1.0),
    (r"^\s*(?:my\s+)?(?:full\s+)?age\s+is\s+(.+?)\s*[.!?]?$", "age", 1.0),
    (r"^\s*(?:call\s+me|you\s+can\s+call\s+me|people\s+call\s+me)\s+(.+?)\s*[.!?]?$", "name", 1.0),
    (r"^\s*(?:my\s+)?(?:username|nickname|full\s+name)\s+is\s+(.+?)\s*[.!?]?$", "name", 1.0),
]
ROLE = r"^\s*(?:i\s+(?:am|'m|am\s+also)|we\s+are)\s+(.+?(?:student|developer|founder|engineer|designer|architect|manager|leader|ceo|cto|pm|analyst|consultant|freelancer|teacher|professor|doctor|nurse|lawyer|writer|artist|musician|entrepreneur))(?:\s+and\s+.+)?\s*[.!?]?$"
ROLE_CONFIDENCE = 0.95
TRANSIENT_ROLES = [
    "tired", "happy", "confused", "sad", "angry", "excited", "hungry", "thirsty", "busy", "bored", "curious", "nervous", "scared", "worried", "proud",
    "ashamed", "grateful", "hopeful", "motivated",
]
WHEREABOUTS = [
    (r"^\s*(?:i\s+am|i'm|i'm\s+from|i'm\s+based\s+in)\s+(.+?)\s*[.!?]?$", "location", 1.0),
    (r"^\s*(?:i\s+live|i\s+stay|i'm\s+based)\s+in\s+(.+?)\s*[.!?]?$", "location", 1.0),
    (r"^\s*(?:i\s+am\s+from|i'm\s+from)\s+(.+?)\s*[.!?]?$", "location", 1.0),
    (r"^\s*(?:i\s+am|i'm)\s+(.+?)\s+(?:years?\s+old|years old)\s*[.!?]?$", "age", 1.0),
]
OWNERSHIP_HAVE = r"^\s*(?:i\s+(?:have|own|maintain|manage|run|operate)|we\s+(?:have|own|maintain|manage|run|operate))\s+(?:a\s+|an\s+)?(.+?)\s*[.!?]?$"
OWNERSHIP_MY = r"^\s*my\s+(.+?)\s+is\s+(.+?)\s*[.!?]?$"
OWNERSHIP_THIS = r"^\s*this\s+is\s+my\s+(.+?)\s*[.!?]?$"
OWNERSHIP_BELONGS = r"^\s*(.+?)\s+belongs\s+to\s+me\s*[.!?]?$"
OWNERSHIP_CONFIDENCE = 0.95
TRANSIENT_POSSESSIONS = ["headache", "question", "idea", "minutes", "opinion", "thought", "concern", "suspicion", "hunch", "feeling", "impression"]
USAGE = [
    (r"^\s*(?:and\s+)?(?:now\s+|currently\s+|these\s+days\s+|at\s+the\s+moment\s+|right\s+now\s+|today\s+)?(?:i\s+(?:currently\s+)?use|i\s+am\s+using|i'm\s+using|we\s+(?:currently\s+)?use|we're\s+using)\s+(.+?)\s*[.!?]?$", 0.98),
    (r"^\s*(?:our\s+(?:system|team|project)\s+uses|my\s+(?:project|app|system)\s+uses)\s+(.+?)\s*[.!?]?$", 0.96),
]
USAGE_NEGATED = r"\b(not|don't|do not|doesn't|did not|never|no longer|without)\b"
USAGE_NEGATED_CONFIDENCE = 0.95
PAST_USAGE = [(r"^\s*(?:i\s+(?:used\s+to\s+use|used|previously\s+used|previously\s+relied\s+on|formerly\s+used|was\s+using|had\s+been\s+using))\s+(.+?)\s*[.!?]?$", 0.95)]
STOPPED_USAGE = [
    (r"^\s*(?:i\s+stopped\s+(?:using\s+)?|i\s+no\s+longer\s+use|i\s+don't\s+use\s+anymore|i\s+do\s+not\s+use\s+anymore|i\s+quit\s+(?:using\s+)?|i\s+abandoned|i\s+moved\s+away\s+from|i\s+switched\s+away\s+from|i\s+replaced\s+|i\s+removed\s+|i\s+discontinued)\s+(.+?)(?:\s+because\s+(.+?))?\s*[.!?]?$", 0.95),
]
PREFERENCES = [
    (r"^\s*(?:i\s+)?prefer\s+(.+?)(?:\s+over\s+(.+?))?\s*[.!?]?$", 0.98),
    (r"^\s*(?:i\s+)?(?:really\s+)?like\s+(.+?)\s*[.!?]?$", 0.95),
    (r"^\s*(?:i\s+)?(?:really\s+)?love\s+(.+?)\s*[.!?]?$", 0.95),
    (r"^\s*(?:i\s+)?(?:would\s+rather\s+use|i'd\s+rather\s+use)\s+(.+?)(?:\s+over\s+(.+?))?\s*[.!?]?$", 0.96),
    (r"^\s*(?:i\s+)?choose\s+(.+?)(?:\s+over\s+(.+?))?\s*[.!?]?$", 0.95),
    (r"^\s*(?:i\s+)?usually\s+choose\s+(.+?)\s*[.!?]?$", 0.92),
]
#: The value is the second group.
PREFERRED_IS = (r"^\s*(?:x|it)\s+is\s+my\s+preferred\s+(.+?)\s+is\s+(.+?)\s*[.!?]?$", 0.95)
DISLIKES = [
    (r"^\s*(?:i\s+don't\s+(?:really\s+)?like|i\s+do\s+not\s+(?:really\s+)?like|i\s+dislike|i\s+hate)\s+(.+?)(?:\s+anymore|\s+any\s+more)?\s*[.!?]?$", 0.95),
    (r"^\s*(?:i\s+never\s+use|i\s+avoid|i\s+don't\s+want\s+to\s+use|i\s+refuse\s+to\s+use)\s+(.+?)\s*[.!?]?$", 0.92),
    (r"^\s*i\s+am\s+not\s+a\s+fan\s+of\s+(.+?)\s*[.!?]?$", 0.85),
]
#: A dislike without a value: it marks a clause's kind, but gives no fact.
DISLIKE_BARE = r"^\s*(?:x|it)\s+is\s+not\s+for\s+me\s*[.!?]?$"
NOT_DISLIKE = r"\bdon't know\b|\bdon't understand\b"
FAVORITES = [
    (r"^\s*(?:my\s+)?(?:favorite|favourite)\s+(.+?)\s+(?:is|are|=|:)\s+(.+?)\s*[.!?]?$", 0.98),
    (r"^\s*(?:my\s+)?(?:preferred|favourite)\s+(.+?)\s+(?:is|are|=|:)\s+(.+?)\s*[.!?]?$", 0.95),
]
FAVORITE_DOMAIN = r"\b(color|colour|food|language|framework|database|editor|ide|os|operating\s+system|programming\s+language|ui\s+library|frontend\s+framework|backend\s+framework|cloud\s+provider|hosting\s+provider|browser|game|movie|book|music|artist|tool)\b"
FAVORITE_NAMES = {
    "color": "color", "colour": "color", "food": "food", "language": "language", "framework": "framework", "database": "database", "editor": "editor", "ide": "ide",
    "os": "os", "operating system": "os", "programming language": "language", "ui library": "ui_library", "frontend framework": "frontend_framework",
    "backend framework": "backend_framework", "cloud provider": "cloud_provider", "hosting provider": "hosting_provider", "browser": "browser", "game": "game",
    "movie": "movie", "book": "book", "music": "music", "artist": "artist", "tool": "tool",
}
GOALS = [(r"^\s*(?:i\s+want\s+to|i\s+would\s+like\s+to|i'd\s+like\s+to|i\s+hope\s+to|i\s+intend\s+to|my\s+goal\s+is\s+to|i\s+aim\s+to|i\s+need\s+to|i\s+wish\s+to)\s+(.+?)\s*[.!?]?$", 0.95)]
PLANS = [(r"^\s*(?:i\s+plan\s+to|i'm\s+planning\s+to|i\s+am\s+planning\s+to|i\s+will\s+probably|i'm\s+going\s+to|i\s+intend\s+to|i\s+expect\s+to|i\s+am\s+preparing\s+to)\s+(.+?)\s*[.!?]?$", 0.95)]
POSSIBLE_PLANS = [
    (r"^\s*(?:i\s+might|i\s+may|i\s+could|maybe\s+i'll|perhaps\s+i'll|i'm\s+considering|i'm\s+thinking\s+about|i\s+am\s+thinking\s+about|i\s+may\s+decide\s+to|i'm\s+not\s+sure\s+but|possibly|there's\s+a\s+chance\s+i'll)\s+(.+?)\s*[.!?]?$", 0.7),
]
DECISIONS = [(r"^\s*(?:i\s+decided\s+to|i've\s+decided\s+to|i\s+have\s+decided\s+to|i\s+chose\s+|i\s+selected\s+|i've\s+chosen\s+|i\s+settled\s+on|we\s+decided\s+to|we\s+chose)\s+(.+?)\s*[.!?]?$", 0.95)]
TEMPORARY = [(r"^\s*(?:i'm\s+testing|i'm\s+trying|i'm\s+debugging|i'm\s+currently\s+debugging|i'm\s+experimenting\s+with|i'm\s+checking\s+|i'm\s+looking\s+at|i'm\s+reading\s+about|i'm\s+learning\s+about)\s+(.+?)\s*[.!?]?$", 0.4)]
CONDITIONAL = r"^\s*(?:if\s+.+\s+then\s+i\s+will|if\s+.+\s+works\s+i'll\s+use|i\s+will\s+use\s+if|i\s+might\s+use\s+if|depending\s+on|unless\s+|provided\s+that|only\s+if)\s+"
CONDITIONAL_ACTION = r"\b(?:will\s+use|will\s+switch|will\s+adopt|will\s+choose)\s+(.+?)\s*[.!?]?$"
CONDITIONAL_CONFIDENCE = 0.6
NEGATION = r"\b(not|don't|do not|doesn't|did not|never|no longer|without|cannot|can't|won't|wouldn't|isn't|is not|aren't|are not|wasn't|was not)\b"

#: The memory gate: what is no memory, how questions begin, phrases that say nothing, words that memories hold.
GREETING = r"^\s*(?:hello|hi|hey|yo|sup|greetings|good\s+morning|good\s+afternoon|good\s+evening|good\s+night)(?:\s+(?:there|folks|everyone|all|team|guys|bro|dude|man|friend))?\s*[!.?]*$"
REQUEST = r"^\s*(?:what\s+is\s+|what's\s+what\s+is\s+|how\s+does\s+.+?\s+work|explain\s+|summarize\s+|translate\s+|rewrite\s+|make\s+a\s+prompt|create\s+a\s+function|give\s+me\s+an\s+example|search\s+for|find\s+|calculate\s+|convert\s+)\s+"
GATE_QUESTION_STARTS = ["what", "why", "how", "when", "where", "who", "which", "should", "can", "could", "would", "is", "are", "do", "does", "did", "will"]
GATE_LOW_INFO = [
    "ok", "okay", "k", "kk", "yes", "yep", "yeah", "yup", "no", "nope", "nah", "thanks", "thank you", "thx", "ty", "cool", "great", "nice", "good", "fine", "sure",
    "got it", "sounds good", "works for me", "makes sense", "understood", "perfect", "awesome",
]
GATE_WORDS = [
    "use", "used", "using", "prefer", "like", "love", "hate", "dislike", "avoid", "want", "plan", "goal", "decided", "chose", "stopped", "no", "longer", "building",
    "creating", "developing", "working", "maintain", "learning", "own", "have", "has", "favorite", "preferred", "intend", "am", "name", "call", "testing", "trying",
    "switching", "migrating", "live", "living", "reside", "residing", "based", "stay", "staying", "hail", "from",
]

#: Confidence of a kind of fact, stated or implied.
CONFIDENCE = {
    "identity": (1.0, 0.85), "preference": (0.98, 0.75), "usage": (0.98, 0.7), "stopped_usage": (0.98, 0.7), "past_usage": (0.95, 0.7), "plan": (0.95, 0.6),
    "possible_plan": (0.7, 0.4), "goal": (0.95, 0.7), "decision": (0.95, 0.7), "ownership": (0.95, 0.75), "temporary": (0.4, 0.25), "ambiguous": (0.7, 0.5),
}

#: Fixed patterns of the validation of facts, read in the clause that names the value.
TEMPORARY_HINT = r"\b(?:testing|trying|experimenting|debugging|checking|looking\s+at|learning\s+about|playing\s+with|evaluating)\b"
CONDITIONAL_HINT = r"\b(?:if|unless|provided\s+that|depending\s+on|only\s+if)\b"
ASKING_START = r"^(?:what|why|how|when|where|who|which|should|can|could|would)\b"
DISLIKING = r"\b(?:don'?t|do\s+not)\s+(?:really\s+)?(?:like|love|enjoy)|hate|dislike|avoid\b"
GOAL_CONDITION = r"\s+\b(?:if|unless)\b.+$"
GOAL_VERB = r"^(?:use|using|to\s+use|switch\s+to)\s+"
CONDITION_ONLY = r"^(?:latency|pricing|cost|performance)\b"
STOPPED_USE = r"\bstopped\s+using\b|\bno\s+longer\s+use\b|\bdon'?t\s+use\b.*\banymore\b"
PAST_USE = r"\bused\s+to\s+use\b|\bpreviously\s+used\b|(?:^|\b)i\s+used\b"
GIVEN_REASON = r"\s+(?:because|due\s+to|since)\s+.+$"
