"""Supplied model output as memory: its strict layouts, its mapping to candidates, and the validation of facts.

Nothing here calls a model; answers come in a table. Rows that break a layout are dropped, malformed answers give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import lexicons as L
from palimpsest.functions import rich
from palimpsest.functions.facts import value_attribute
from palimpsest.functions.scoring import candidate_scores, clamp01, rounded, stability_score
from palimpsest.functions.text import clauses, clean_value, group, interrogative, json_text, let, matches, slug, smallest_clause

#: What a model's answer may say.
ACTIONS = ["NEW", "REINFORCE", "SUPERSEDES", "CONTRADICTS", "UPDATE", "DISCARD"]
DESTINATIONS = ["STORE", "CONTEXT", "DISCARD"]
SCOPES = ["USER", "PROJECT", "SESSION"]
STABILITIES = ["permanent", "long-term", "short-term", "session"]
TYPES = ["FACT", "PREFERENCE", "DECISION", "GOAL", "CONSTRAINT", "ARCHITECTURE", "IMPORTANT_EVENT", "ACTIVE_TASK", "TEMPORARY_STATE"]
FACT_TYPES = {
    "identity": "fact", "fact": "fact", "preference": "preference", "dislike": "preference", "favorite": "preference", "goal": "goal", "plan": "goal", "possible_plan": "goal", "decision": "decision",
    "usage": "fact", "past_usage": "fact", "stopped_usage": "fact", "temporary": "temporary_state", "event": "important_event", "action": "important_event", "architecture": "architecture",
    "constraint": "constraint", "active_task": "active_task",
}
STATES = {"current": "current", "present": "current", "past": "past", "planned": "planned", "future": "planned", "possible": "possible", "uncertain": "possible", "conditional": "conditional", "stopped": "stopped", "discontinued": "stopped", "superseded": "superseded"}
USER_OWNED = ["name", "occupation", "preference", "dislike", "goal", "plan", "experiment"]
SINGLE_VALUED = ["name", "occupation", "project"]
PROJECT_WORDS = ["it", "this", "that", "the project", "the app", "the system", "project"]

_CANDIDATE = "struct<action:string,destination:string,type:string,scope:string,subject:string,predicate:string,value:string,topicKey:string,confidence:double,importance:double,stability:string,ttl_hours:double,informationGain:double,rawText:string,supersedes_id:string>"
_RECORD = "struct<type:string,scope:string,subject:string,predicate:string,value:string,topicKey:string,confidence:double,importance:double,stability:string,sourceMemoryIds:array<string>,consolidationNote:string>"


def _one_of(c: Column, allowed: list[str], default: str, upper: bool = True) -> Column:
    x = F.upper(c) if upper else F.lower(c)
    return F.when(x.isin(allowed), x).otherwise(default)


def _map(names: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)


def ai_candidates(answers: DataFrame, column: str = "answer", least: float = 0.4) -> DataFrame:
    """Validated candidates of answers {"candidates": [..]}: unknown actions, discards, blanks and low confidence go."""
    keep = [c for c in answers.columns if c != column]
    parsed = F.from_json(json_text(F.col(column)), f"struct<candidates:array<{_CANDIDATE}>>")["candidates"]
    c = lambda n: F.col(f"c.{n}")
    rows = answers.select(*keep, F.posexplode(parsed).alias("n", "c"))
    action, destination = F.upper(F.coalesce(c("action"), F.lit("NEW"))), F.upper(F.coalesce(c("destination"), F.lit("STORE")))
    out = rows.select(
        *keep, "n", action.alias("action"), destination.alias("destination"), F.upper(F.coalesce(c("type"), F.lit("FACT"))).alias("type"), _one_of(F.coalesce(c("scope"), F.lit("USER")), SCOPES, "USER").alias("scope"),
        F.coalesce(c("subject"), F.lit("user")).alias("subject"), F.trim(c("predicate")).alias("predicate"), F.trim(c("value")).alias("value"), F.trim(c("topicKey")).alias("topic"),
        clamp01(c("confidence"), 0.8).alias("confidence"), clamp01(c("importance"), 0.7).alias("importance"), _one_of(F.coalesce(c("stability"), F.lit("long-term")), STABILITIES, "long-term", False).alias("stability"),
        c("ttl_hours").alias("ttl_hours"), clamp01(c("informationGain"), 0.8).alias("gain"), c("rawText").alias("raw_text"), c("supersedes_id").alias("supersedes_id"),
    )
    allowed = F.col("action").isin(ACTIONS) & F.col("destination").isin(DESTINATIONS) & (F.col("action") != "DISCARD") & (F.col("destination") != "DISCARD")
    return out.where(allowed & (F.col("value") != "") & (F.col("predicate") != "") & (F.col("confidence") >= least))


def as_candidates(rows: DataFrame, as_of: Column) -> DataFrame:
    """Validated model candidates as the fold's candidates, their scores blended with the local ones."""
    kind = F.when(F.col("type").isin(TYPES), F.lower("type")).otherwise("fact")
    scope = F.lower("scope")
    topic = F.coalesce(F.nullif("topic", F.lit("")), F.concat(scope, F.lit("."), "predicate"))
    update = F.col("action").isin("SUPERSEDES", "CONTRADICTS")
    content = F.when(kind == "preference", F.col("value")).otherwise(F.coalesce(F.nullif("raw_text", F.lit("")), F.concat("predicate", F.lit(": "), "value")))
    local = candidate_scores(content, kind, F.lit("user"), update)
    until = F.when(F.col("ttl_hours") > 0, as_of + F.make_dt_interval(hours=F.col("ttl_hours").cast("int")))
    known = ["action", "destination", "type", "scope", "subject", "predicate", "value", "topic", "confidence", "importance", "stability", "ttl_hours", "gain", "raw_text", "supersedes_id"]
    return rows.withColumn("s", local).select(
        *[c for c in rows.columns if c not in known], content.alias("content"), kind.alias("type"), topic.alias("topic_key"), F.lit("user").alias("authority"), update.alias("is_correction"),
        F.when(F.col("destination") == "CONTEXT", "context").otherwise("store").alias("bucket"), "subject", "predicate", "value", scope.alias("scope"),
        F.least(F.lit(1.0), F.col("confidence") * F.greatest(F.lit(0.85), F.col("s.confidence"))).alias("confidence"), F.greatest("importance", F.col("s.importance")).alias("importance"),
        stability_score(F.col("stability")).alias("stability"), F.greatest("gain", F.lit(0.85)).alias("information_gain"), until.alias("valid_until"),
    )


def not_present(rows: DataFrame, present: DataFrame) -> DataFrame:
    """Candidates whose content, whatever its case, is not among those of the same user already there."""
    known = present.select("user_id", F.lower("content").alias("__c")).distinct()
    return rows.withColumn("__c", F.lower("content")).join(known, ["user_id", "__c"], "left_anti").drop("__c")


def consolidations(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Validated records of answers {"consolidated": [..]}, at most two of each."""
    keep = [c for c in answers.columns if c != column]
    parsed = F.slice(F.from_json(json_text(F.col(column)), f"struct<consolidated:array<{_RECORD}>>")["consolidated"], 1, 2)
    c = lambda n: F.col(f"c.{n}")
    scope = _one_of(F.coalesce(c("scope"), F.lit("PROJECT")), SCOPES, "PROJECT")
    rows = answers.select(*keep, F.posexplode(parsed).alias("n", "c")).where(F.trim(F.coalesce(c("predicate"), F.lit(""))) != "")
    return rows.select(
        *keep, "n", F.upper(F.coalesce(c("type"), F.lit("ARCHITECTURE"))).alias("type"), scope.alias("scope"), F.coalesce(c("subject"), F.lit("project")).alias("subject"), F.trim(c("predicate")).alias("predicate"),
        c("value").alias("value"), F.coalesce(c("topicKey"), F.concat(F.lower(scope), F.lit("."), F.trim(c("predicate")))).alias("topic_key"), clamp01(c("confidence"), 0.8).alias("confidence"),
        clamp01(c("importance"), 0.9).alias("importance"), _one_of(F.coalesce(c("stability"), F.lit("long-term")), STABILITIES, "long-term", False).alias("stability"),
        F.coalesce(c("sourceMemoryIds"), F.array().cast("array<string>")).alias("source_ids"),
    )


# validation of facts --------------------------------------------------------------------------------------------


def comparison(value: Column) -> Column:
    """struct(value, preferred_over) of `A over B` or `A than B`."""
    p = r"^(.+?)\s+(?:over|than)\s+(.+)$"
    return F.when(matches(value, p), F.struct(clean_value(group(value, p, 1)).alias("value"), clean_value(group(value, p, 2)).alias("preferred_over"))).otherwise(
        F.struct(clean_value(value).alias("value"), F.lit(None).cast("string").alias("preferred_over")))


def condition(text: Column) -> Column:
    return F.nullif(clean_value(group(text, r"\b(?:if|unless|provided\s+that|depending\s+on|only\s+if)\s+(.+)$", 1)), F.lit(""))


def reason(text: Column) -> Column:
    return F.nullif(clean_value(group(text, r"\b(?:because|due\s+to|since)\s+(.+)$", 1)), F.lit(""))


def atomic_uses(value: Column) -> Column:
    """Array of struct(attribute, value): listed things one by one; `database` only where the purpose says so."""

    def one(x: Column) -> Column:
        bare = clean_value(F.regexp_replace(x, r"(?i)\s+(?:as|for)\s+.*$", ""))
        named = matches(x, r"\b(?:as|for)\s+(?:the\s+)?(?:database|db)\b") & (value_attribute(x) == "database")
        return F.struct(F.when(named, "database").otherwise("uses").alias("attribute"), bare.alias("value"))

    return F.array_distinct(F.filter(F.transform(clauses(clean_value(value)), one), lambda x: x["value"] != ""))


def person_name(entity: Column, known: Column) -> Column:
    """Whether an entity is one of the known names (lower case) or two or more capitalised words that are no technology."""
    low = F.lower(F.trim(entity))
    tech = low.isin(sorted({*L.DB, *L.FRONTEND, *L.LANGUAGE, *L.RUNTIME, *L.FRAMEWORK, *L.UI}))
    named = F.size(F.split(F.trim(entity), r"\s+")) >= 2
    return ~low.isin("", "user", "project", "session", "my", "we", "our") & (F.array_contains(known, low) | (~tech & named & F.trim(entity).rlike(r"^[A-Z][a-z'-]*(?:\s+[A-Z][a-z'-]*)+$")))


def type_of(attribute: Column, state: Column) -> Column:
    unsure = state.isin("planned", "possible", "conditional")
    return F.when(attribute.isin("preference", "dislike"), "preference").when(attribute.isin("goal", "plan"), "goal").when(attribute == "experiment", "temporary_state").when(attribute == "database", "decision").when((attribute == "uses") & unsure, "goal").otherwise("fact")


def _classed(rows: DataFrame) -> DataFrame:
    """Attribute, value and state of facts by what their clause says; questions and conditions alone go.

    In this order: what is only tried is an experiment; a preference; what the clause dislikes; a goal or plan, its condition and
    its verb taken off; names; used things, which may have been stopped or be past. `type` is the memory's type that was told.
    """
    clause, attribute, state, value = F.col("clause"), F.col("attribute"), F.col("state"), F.col("value")
    text = F.trim(clause)
    tried = (attribute == "experiment") | matches(clause, L.TEMPORARY_HINT) | (F.col("type") == "temporary_state")
    asks = interrogative(clause) | text.endswith("?") | matches(text, L.ASKING_START)
    prefers = ((attribute == "preference") | (F.col("type") == "preference")) & (attribute != "dislike")
    dislikes = (attribute == "dislike") | matches(clause, L.DISLIKING)
    aims = attribute.isin("goal", "plan") | (F.col("type") == "goal")
    kind = F.when(tried, "tried").when(prefers, "prefers").when(dislikes, "dislikes").when(aims, "aims").when(attribute.isin("name", "occupation", "project"), "named").when(attribute.isin("uses", "database"), "uses")
    rows = rows.where(tried | ~asks).withColumn("__kind", kind)
    kind = F.col("__kind")
    without = lambda c, p: F.regexp_replace(c, "(?i)" + p, "")
    bare = F.trim(without(value, L.GOAL_CONDITION))
    aim = clean_value(F.coalesce(F.nullif(without(bare, L.GOAL_VERB), F.lit("")), bare))
    rows = rows.withColumn("__aim", F.when(kind == "aims", aim))
    rows = rows.where(~F.coalesce((kind == "aims") & (matches(F.col("__aim"), L.CONDITION_ONLY) | matches(text, r"^if\b")), F.lit(False)))
    unsure = state.isin("possible", "conditional") | matches(clause, L.CONDITIONAL_HINT)
    stopped = matches(clause, L.STOPPED_USE)
    used = F.when(stopped, "stopped").when(matches(clause, L.PAST_USE) & ~matches(clause, r"\bnow\b"), "past").when(rich.negated(clause) & (state == "current"), "stopped").when(state.isin("past", "stopped"), state).otherwise("current")
    return rows.withColumns({
        "attribute": F.when(kind == "tried", "experiment").when(kind == "prefers", "preference").when(kind == "dislikes", "dislike").when((kind == "aims") & (unsure | (attribute == "plan") | matches(clause, r"\bplan\b")), "plan").when(kind == "aims", "goal").otherwise(attribute),
        "value": F.when(kind == "dislikes", clean_value(without(value, r"\s+anymore\s*$"))).when(kind == "aims", F.coalesce(F.nullif("__aim", F.lit("")), value)).when((kind == "uses") & stopped, clean_value(without(value, L.GIVEN_REASON))).otherwise(value),
        "state": F.when(kind.isin("tried", "prefers", "dislikes", "named"), "current").when((kind == "aims") & unsure, F.when(state == "possible", "possible").otherwise("conditional")).when(kind == "aims", "planned").when(kind == "uses", used).otherwise(state),
    }).drop("__kind", "__aim")


def validated(rows: DataFrame, source: str = "source") -> DataFrame:
    """Facts (message columns, entity, attribute, value, type, state, scope, confidence, source text) made strict.

    Attributes outside the list, questions and blanks go; lists of used things become one fact each; preferences keep what
    they are preferred over, conditions and reasons are taken from the clause that names the value; entities are the user,
    the project's name or `project`; of facts with one identity the most confident stays.
    """
    own = ["entity", "attribute", "value", "type", "state", "scope", "confidence", source]
    keep = [c for c in rows.columns if c not in own]
    a = rich.canonical_attribute(F.col("attribute"))
    out = rows.withColumn("attribute", a).where(F.col("attribute").isNotNull() & (F.trim("value") != "") & ~F.trim("value").endswith("?"))
    out = out.withColumn("state", F.coalesce(_map(STATES, F.lower("state")), F.lit("current"))).withColumn("clause", smallest_clause(F.col(source), F.col("value")))
    out = _classed(out.withColumn("type", F.coalesce(_map(FACT_TYPES, F.lower("type")), F.lit("fact"))))
    parts = F.when(F.col("attribute").isin("uses", "database"), atomic_uses(F.col("value"))).otherwise(F.array(F.struct(F.col("attribute").alias("attribute"), F.col("value").alias("value"))))
    out = out.withColumn("part", F.explode(parts)).withColumn("attribute", F.when(F.col("attribute") == "database", "database").otherwise(F.col("part.attribute")))
    out = out.withColumn("c", F.when(F.col("attribute") == "preference", comparison(F.col("part.value"))).otherwise(F.struct(clean_value(F.col("part.value")).alias("value"), F.lit(None).cast("string").alias("preferred_over"))))
    value = F.col("c.value")
    if not keep:
        raise ValueError("facts need columns that name their message")
    by = Window.partitionBy(*keep)
    out = out.withColumn("project", F.max(F.when(F.col("attribute") == "project", value)).over(by)).withColumn("names", F.collect_set(F.when(F.col("attribute") == "name", F.lower(value))).over(by))
    owned = F.col("attribute").isin(USER_OWNED)
    conditional = F.col("attribute").isin("goal", "plan") & F.col("state").isin("possible", "conditional")
    scope = F.when(F.col("attribute") == "experiment", "session").when(F.col("attribute") == "project", "project").when(owned, "user").otherwise(F.coalesce(F.lower("scope"), F.lit("user")))
    whose = F.coalesce(F.col("project"), F.lit("project"))
    entity = F.when(F.col("attribute") == "project", value).when(owned | F.lower("entity").isin("we", "our", "my", "user"), "user").when(F.lower("entity").isin(PROJECT_WORDS), whose).when(person_name(F.col("entity"), F.col("names")), F.when(scope == "project", whose).otherwise("user")).otherwise(F.col("entity"))
    out = out.select(
        *keep, entity.alias("entity"), "attribute", value.alias("value"), type_of(F.col("attribute"), F.col("state")).alias("type"), "state", scope.alias("scope"), "confidence", "clause",
        F.col("c.preferred_over").alias("preferred_over"), F.when(conditional, condition(F.col("clause"))).alias("condition"), F.when(F.col("state") == "stopped", reason(F.col("clause"))).alias("reason"),
    )
    single = F.col("attribute").isin(SINGLE_VALUED)
    key = F.when(F.col("attribute") == "project", "project.name").when(single, F.concat_ws(".", "scope", "attribute")).otherwise(F.concat_ws(".", "scope", "attribute", slug(F.col("value"))))
    out = out.withColumn("key", key)
    w = Window.partitionBy(*keep, "key", F.when(~single, F.col("state"))).orderBy(F.col("confidence").desc(), F.length("clause"), "value")
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def budget(*given: Column) -> Column:
    """The first given budget that there is, if it is a positive number; else 8000."""
    return let(F.coalesce(*given).try_cast("double"), lambda x: F.when(x > 0, x).otherwise(8000.0))


def compile_versions(compiled: DataFrame, latest: DataFrame, as_of: Column) -> DataFrame:
    """Rows to append for compiled requests: their statistics as JSON, a version above the latest."""
    state = F.to_json(F.struct("budget", F.col("tokens_out").alias("total_tokens"), F.col("selected").alias("message_count"), F.col("memory_used").alias("canonical_items_count")))
    return compiled.join(latest, "user_id", "left").select("user_id", (F.coalesce("version", F.lit(0)) + 1).alias("version"), F.lit("compile").alias("kind"), state.alias("state_json"), as_of.alias("created_at"))


def latency_report(samples: DataFrame) -> DataFrame:
    """(name, avg, p50, p95, n): percentiles are the element at floor(n * p) of the sorted values.

    A histogram (64 buckets an octave) tells in which bucket that element is; only that bucket's distinct values are then
    ordered, so no task holds or sorts a name's values.
    """
    ms = F.col("ms")
    octave = lambda x: F.floor(F.log2(x) * 64)
    # in the order of the values: those below zero, zero, those above
    rows = samples.where("ms is not null").select("name", "ms", F.when(ms > 0, octave(ms)).when(ms == 0, -100_000).otherwise(-200_000 - octave(-ms)).alias("b"))
    counts = rows.groupBy("name", "b").agg(F.count("*").alias("c"))
    own = Window.partitionBy("name")
    counts = counts.withColumns({"upto": F.sum("c").over(own.orderBy("b")), "n": F.sum("c").over(own)}).withColumn("p", F.explode(F.array(F.lit(0.5), F.lit(0.95))))
    at = F.least(F.col("n"), F.floor(F.col("n") * F.col("p")) + 1)
    there = counts.where((at > F.col("upto") - F.col("c")) & (at <= F.col("upto"))).select("name", "b", "p", (at - F.col("upto") + F.col("c")).alias("k"))
    values = rows.join(there, ["name", "b"]).groupBy("name", "p", "k", "ms").agg(F.count("*").alias("c"))
    values = values.withColumn("upto", F.sum("c").over(Window.partitionBy("name", "p").orderBy("ms"))).where("upto >= k")
    found = values.groupBy("name").agg(*[F.round(F.min(F.when(F.col("p") == p, F.col("ms"))), 1).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))])
    means = rows.groupBy("name").agg(F.round(F.avg("ms"), 1).alias("avg"), F.count("*").cast("int").alias("n"))
    return means.join(found, "name").select("name", "avg", "p50", "p95", "n")


def reduction(compiled: DataFrame) -> DataFrame:
    """(user_id, percent): how many fewer tokens go out than came in."""
    return compiled.select("user_id", rounded((1 - F.col("tokens_out") / F.col("tokens_in")) * 100, 1).alias("percent"))


