"""From messages to candidates: gates, one message to many facts, corrections and revocations, and three-way routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import lexicons as L
from palimpsest.functions import rich
from palimpsest.functions.facts import FACT, classified, content_of, content_topic, correction, domain, domain_topic, fact, labelled, revocation, single_fact, switch, topic_of, uses_list
from palimpsest.functions.text import authority, boundary_sentences, correction_like, first_match, group, interrogative, let, low_info, matches, nfkc, noise, preference_noise, sentences, speculative, strip_correction_prefix, trimmed
from palimpsest.sources.tables import spread_by

_COMPOUND = r"^(.+?)\s+and\s+I\s+prefer\s+(.+)$"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, each column computed here once: what comes later names columns, not the expressions behind them.

    A generator of one row keeps the optimizer from copying long expressions into every filter and projection above.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def gated(messages: DataFrame) -> DataFrame:
    """Messages of users and assistants that say something, ask nothing and do not speculate; what says nothing is told by its composed form."""
    c, role = F.col("content"), F.col("role")
    own = messages.where(role.isin("user", "assistant")).where(~interrogative(c) & ~speculative(c))
    return own.withColumn("__composed", nfkc(c)).where(~low_info(F.col("__composed"), role)).drop("__composed")


def sentence_facts(s: Column) -> Column:
    """Array of the facts of one sentence: a list of used things, a compound with `and I prefer`, or one fact."""
    listed = F.coalesce(uses_list(s), F.array().cast(f"array<{FACT}>"))
    # the two parts of a compound, then the whole; the extractors stand in the plan once
    tries = F.array(trimmed(group(s, _COMPOUND, 1)), F.when(matches(s, _COMPOUND), F.concat(F.lit("I prefer "), trimmed(group(s, _COMPOUND, 2)))).otherwise(""), s)

    def choose(found: Column) -> Column:
        both = F.array_compact(F.slice(found, 1, 2))
        return F.when(F.size(both) > 0, both).otherwise(F.array_compact(F.slice(found, 3, 1)))

    return let(listed, lambda x: F.when(F.size(x) > 0, x).otherwise(let(F.transform(tries, single_fact), choose)))


def _correction_fact(c: Column) -> Column:
    """The fact that a correction states."""
    target, old, new = c["target"], c["old_value"], c["new_value"]
    prefers = F.lower(target).isin("preference", "my preference", "choice")
    d = domain(new, old)
    kind = F.when(matches(target, r"\b(target|deployment|database|db|provider|stack|hosting)\b"), "decision").when(F.contains(F.lower(target), F.lit("prefer")), "preference").otherwise("fact")
    none = F.lit(None).cast("string")
    return (
        F.when(prefers, fact(F.lit("user"), d, new, "preference", none, none)).when(old == "", fact(target, target, new, kind, none, none))
        .otherwise(fact(target, d, new, F.when(d.isin("database", "ui_library", "frontend_framework", "theme", "workflow"), "decision").otherwise("fact"), none, none))
    )


def candidates(messages: DataFrame) -> DataFrame:
    """Candidates of messages (user_id, message_key, ordinal, role, content, and what else they carry), in reading order.

    `sentence`, `part`: where a candidate stands. A fact's key counts once in a message. Other columns of the messages stay, but
    for those that have a result's name.
    """
    results = ("sentence", "part", "type", "topic_key", "authority", "is_correction", "correction", "revocation", "fact")
    messages = messages.drop(*results)
    stripped, had = strip_correction_prefix(F.col("content"))
    base = gated(messages).withColumns({"__stripped": stripped, "__had_prefix": had})
    base = base.where(~interrogative(F.col("__stripped"))).withColumns({"revocation": revocation(F.col("__stripped")), "correction": correction(F.col("__stripped"))})
    whole = F.col("revocation").isNotNull() | F.col("correction").isNotNull()
    keep = [c for c in base.columns]
    rows = base.select(*keep, F.posexplode_outer(F.when(whole, F.array(F.lit(None).cast("string"))).otherwise(sentences(F.col("__stripped")))).alias("sentence", "__s"))
    s = F.col("__s")
    rows = rows.withColumn("__update", switch(s)).withColumn("__quiet", s.isNull() | low_info(s, F.col("role")) | interrogative(s))
    found = F.when(F.col("__quiet"), F.array().cast(f"array<{FACT}>")).when(F.col("__update").isNotNull(), F.array("__update")).otherwise(sentence_facts(s))
    rows = rows.withColumn("__found", found).select(*keep, "sentence", F.posexplode_outer("__found").alias("part", "fact"))
    # what follows the windows is much work, too
    by = ["user_id", "message_key", "ordinal"]
    rows, by_message = spread_by(rows, *by), Window.partitionBy(*by)
    key = F.coalesce(F.col("fact.fact_key"), topic_of(F.col("fact")))
    rows = rows.withColumn("__key", F.when(F.col("fact").isNotNull() & ~F.col("fact.is_update"), key))
    rows = rows.withColumns({
        "__turn": F.when(F.col("__key").isNotNull(), F.row_number().over(Window.partitionBy("user_id", "message_key", "ordinal", "__key").orderBy("sentence", "part"))).otherwise(1),
        "__facts": F.count("fact").over(by_message), "__first": F.row_number().over(by_message.orderBy("sentence", "part")),
    })
    rows = rows.where((F.col("fact").isNotNull() & (F.col("__turn") == 1)) | ((F.col("__facts") == 0) & (F.col("__first") == 1)))
    lone = F.col("fact").isNull() & F.col("revocation").isNull() & F.col("correction").isNull()
    rows = rows.withColumn("__text", F.when(lone, classified(F.col("__stripped")))).withColumn("__corrected", F.when(F.col("correction").isNotNull(), _correction_fact(F.col("correction"))))
    unlabelled = (F.col("role") == "assistant") & labelled(F.col("content"))[0].isNull()
    rows = rows.where(F.when(F.col("revocation").isNotNull(), F.col("role") == "user").when(lone, F.col("__text").isNotNull() & ~unlabelled).otherwise(True))
    f = F.coalesce(F.col("fact"), F.col("__corrected"), F.col("__text.fact"))
    rows = rows.withColumn("__f", f)
    f = F.col("__f")
    kind = F.when(F.col("revocation").isNotNull(), "fact").otherwise(F.coalesce(F.col("__text.memory_type"), f["memory_type"]))
    body = F.when(F.col("revocation").isNotNull(), F.concat(F.lit("REVOKE: "), F.col("revocation.target"))).otherwise(F.coalesce(F.col("__text.body"), content_of(f)))
    prefers = F.lower(F.col("correction.target")).isin("preference", "my preference", "choice")
    topic = F.when(F.col("revocation").isNotNull(), "__revocation__").when(prefers, domain_topic(F.col("correction.new_value"))).when(f.isNotNull(), topic_of(f)).otherwise(content_topic(F.col("__text.body"), F.col("__text.memory_type")))
    told = F.when(F.col("revocation").isNotNull(), "user").when((F.col("role") == "assistant") & kind.isin("decision", "constraint") & F.col("correction").isNull(), "speculation").otherwise(authority(F.col("role"), F.col("content")))
    corrects = F.when(F.col("revocation").isNotNull(), False).when(F.col("correction").isNotNull(), True).otherwise(correction_like(F.col("content")) | F.coalesce(f["is_update"], F.lit(False)) | (F.col("__text").isNotNull() & F.col("__had_prefix")))
    extra = [c for c in messages.columns if c not in ("content", "role")]
    out = rows.select(*extra, "sentence", F.coalesce("part", F.lit(0)).alias("part"), body.alias("content"), kind.alias("type"), topic.alias("topic_key"), told.alias("authority"), corrects.alias("is_correction"), "correction", "revocation", F.col("__f").alias("fact"))
    return settled(out)


def fields(c: DataFrame) -> DataFrame:
    """Adds subject, predicate, value, scope: the fact's, else the key and value of the text, else its type and text."""
    key, value = group(trimmed(F.col("content")), L.KEY_VALUE, 1), group(trimmed(F.col("content")), L.KEY_VALUE, 2)
    paired = matches(trimmed(F.col("content")), L.KEY_VALUE)
    has, f = F.col("fact").isNotNull(), F.col("fact")
    own = lambda name, default: F.coalesce(F.nullif(f[name], F.lit("")), default)
    return c.withColumns({
        "subject": F.when(has, own("entity", F.lit("project"))).otherwise("project"),
        "predicate": F.when(has, own("attribute", F.lit("attribute"))).when(paired, F.regexp_replace(F.lower(trimmed(key)), r"\s+", "_")).otherwise(F.col("type")),
        "value": F.when(has, own("value", F.col("content"))).when(paired, trimmed(value)).otherwise(F.col("content")),
        "scope": F.when(has, own("scope", F.lit("project"))).otherwise("project"),
    })


def bucket() -> Column:
    """store, context or discard."""
    text = trimmed(F.col("content"))
    value = F.coalesce(F.nullif(F.col("fact.value"), F.lit("")), text)
    return (
        F.when(noise(text), "discard").when((F.col("type") == "preference") & preference_noise(value), "discard").when(matches(text, L.CONTEXT_MARKERS), "context")
        .when(F.col("is_correction") | F.col("correction").isNotNull() | F.col("revocation").isNotNull(), "store").when(F.col("type").isin(L.DURABLE_TYPES), "store")
        .when(F.col("type").isin("active_task", "temporary_state"), "context").otherwise("discard")
    )


def context_key(content: Column) -> Column:
    return first_match(F.lower(content), L.CONTEXT_KEYS, F.lit("recent_decisions"))


def context_ttl(key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in L.TTL_SECONDS.items() for x in kv]), key), F.lit(L.TTL_DEFAULT))


def routed(c: DataFrame) -> DataFrame:
    """Candidates with their fields and bucket; transient ones with the context key and how long it holds."""
    out = fields(c).withColumn("bucket", bucket())
    key = F.when(F.col("bucket") == "context", context_key(F.col("content")))
    return settled(out.withColumn("context_key", key)).withColumn("ttl_seconds", F.when(F.col("context_key").isNotNull(), context_ttl(F.col("context_key"))))


def bucket_counts(c: DataFrame) -> DataFrame:
    return routed(c).groupBy("bucket").agg(F.count("*").alias("n"))


def rich_facts(messages: DataFrame) -> DataFrame:
    """The richer extractors over every clause; a message's key and value count once, the first in reading order."""
    rows = messages.select("user_id", "message_key", F.posexplode(boundary_sentences(F.col("content"))).alias("clause", "text"))
    rows = rows.select("user_id", "message_key", "clause", F.posexplode(rich.clause_facts(F.col("text"))).alias("part", "f")).select("user_id", "message_key", "clause", "part", "f.*")
    w = Window.partitionBy("user_id", "message_key", "fact_key", "value").orderBy("clause", "part")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def routes(messages: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """(user_id, message_key, route, confidence): skip, local, or model where `supplied` has facts of the message.

    `supplied` (user_id, message_key, confidence) are validated facts of a model; nothing here calls one.
    """
    by = ["user_id", "message_key"]
    gate = messages.select(*by, "content", nfkc(F.col("content")).alias("__composed")).select(*by, rich.memory_gate(F.col("content"), F.col("__composed")).alias("g"))
    local = rich_facts(messages).groupBy(*by).agg(F.count("*").alias("n"), F.max("confidence").alias("best"))
    rows = gate.join(local, by, "left")
    if supplied is not None:
        rows = rows.join(supplied.groupBy(*by).agg(F.max("confidence").alias("model_best")), by, "left")
    else:
        rows = rows.withColumn("model_best", F.lit(None).cast("double"))
    some, sure = F.coalesce("n", F.lit(0)) > 0, F.col("g.confidence")
    skip = ~F.col("g.call_model") & (F.size("g.kinds") == 0)
    local_only = (some & (sure >= 0.9)) | ~F.col("g.call_model")
    called = ~skip & ~local_only
    told = F.greatest("best", "model_best")
    alone = F.when(some, 0.7).otherwise(0.3) if supplied is None else F.coalesce("best", F.lit(0.3))
    confidence = F.when(skip, sure).when(called, F.when(F.col("model_best").isNotNull(), told).otherwise(alone)).when(some, sure).otherwise(0.5)
    return rows.select(*by, F.when(skip, "skip").when(called & F.col("model_best").isNotNull(), "model").otherwise("local").alias("route"), confidence.alias("confidence"))


def merged_facts(local: DataFrame, model: DataFrame) -> DataFrame:
    """Local and supplied model facts (user_id, attribute, value, confidence, extra): the most confident of each, local before model.

    A `metadata` map, if they have one, is that of all facts of an identity; of a key the most confident fact's value.
    """
    both = local.withColumn("__from", F.lit(0)).unionByName(model.withColumn("__from", F.lit(1)), allowMissingColumns=True)
    own = Window.partitionBy("user_id", rich.canonical_attribute(F.col("attribute")), F.lower("value"))
    rows = both.withColumn("__n", F.row_number().over(own.orderBy(F.col("confidence").desc(), "__from")))
    if "metadata" in both.columns:
        every = F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))).alias("m"))).over(own))
        empty = F.create_map().cast("map<string,string>")
        more = lambda acc, x: F.map_concat(acc, F.map_filter(F.map_from_entries(x["m"]), lambda k, _: ~F.map_contains_key(acc, k)))
        rows = rows.withColumn("metadata", F.aggregate(every, empty, more))
    return rows.where("__n = 1").drop("__n", "__from")


#: The strict layout of supplied model facts.
MODEL_FACTS = "array<struct<entity:string,attribute:string,value:string,type:string,state:string,scope:string,confidence:double,rawText:string,metadata:map<string,string>>>"


def model_facts(answers: DataFrame, column: str = "answer", least: float = 0.4) -> DataFrame:
    """Facts of supplied model answers (JSON, fenced or bare); rows that break the layout are dropped."""
    from palimpsest.functions.scoring import clamp01
    from palimpsest.functions.text import json_text

    text = json_text(F.col(column))
    keep = [c for c in answers.columns if c != column]
    rows = answers.select(*keep, F.explode(F.from_json(text, MODEL_FACTS)).alias("f"))
    over = F.transform_keys("f.metadata", lambda k, _: F.when(k == "over", "preferred_over").otherwise(k))
    # an attribute outside the list is rejected
    out = rows.select(*keep, F.col("f.entity").alias("entity"), rich.canonical_attribute(F.col("f.attribute")).alias("attribute"), F.trim("f.value").alias("value"), F.lower("f.type").alias("type"), F.lower("f.state").alias("state"), clamp01(F.col("f.confidence"), 0.5).alias("confidence"), over.alias("metadata"))
    return out.where((F.coalesce(F.col("value"), F.lit("")) != "") & F.col("attribute").isNotNull() & (F.col("confidence") >= least))


