"""Summaries of a user's memory: snapshots, counts, clusters of a technology stack and their consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import lexicons as L
from palimpsest.functions.scoring import stability_label, stability_score
from palimpsest.functions.text import first_match

#: The lists of a snapshot and the type that each gathers.
SNAPSHOT = {"facts": "fact", "decisions": "decision", "constraints": "constraint", "preferences": "preference", "goals": "goal", "architecture": "architecture", "important_events": "important_event", "active_tasks": "active_task"}


def _listed(kind: str) -> Column:
    """A type's contents in the order of their ids."""
    rows = F.collect_list(F.when((F.col("type") == kind) & (F.col("content") != ""), F.struct("id", "content")))
    return F.transform(F.array_sort(rows), lambda x: x["content"])


def snapshot(items: DataFrame) -> DataFrame:
    """One row a user: the active contents by type; transient ones are left out."""
    return items.where("status = 'active'").groupBy("user_id").agg(*[_listed(kind).alias(name) for name, kind in SNAPSHOT.items()])


def latest_version(versions: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, version), 0 for users without any."""
    top = versions.groupBy("user_id").agg(F.max("version").alias("version"))
    return users.select("user_id").distinct().join(top, "user_id", "left").select("user_id", F.coalesce("version", F.lit(0)).alias("version"))


def next_version(items: DataFrame, versions: DataFrame, as_of: Column) -> DataFrame:
    """Snapshot rows to append: each user's state as JSON, a version above the latest."""
    state = snapshot(items).select("user_id", F.to_json(F.struct(*SNAPSHOT)).alias("state_json"))
    return state.join(latest_version(versions, state), "user_id").select("user_id", (F.col("version") + 1).alias("version"), F.lit("memory").alias("kind"), "state_json", as_of.alias("created_at"))


def action_counts(actions: DataFrame) -> DataFrame:
    """(user_id, action, n): how often the fold did what."""
    return actions.groupBy("user_id", "action").agg(F.count("*").alias("n"))


def type_counts(items: DataFrame) -> DataFrame:
    """(user_id, type, n, active)."""
    return items.groupBy("user_id", "type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("active"))


def changed(results: DataFrame) -> DataFrame:
    """(user_id, changed): whether any applied action altered the memory."""
    return results.groupBy("user_id").agg(F.bool_or(F.col("action").isin("create", "merge", "supersede", "revoke")).alias("changed"))


def stack_field() -> Column:
    """The field of a technology stack that an item is about, or null: by predicate, topic's end, words of the value."""
    topic = F.lower(F.coalesce("topic_key", F.lit("")))
    own = F.lower(F.trim(F.coalesce("predicate", F.lit(""))))
    after = F.when(topic.contains(":"), F.element_at(F.split(topic, ":"), -1)).otherwise(F.element_at(F.split(topic, r"\."), -1))
    predicate = F.when(own != "", own).otherwise(F.trim(after))
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in L.STACK_FIELDS.items() for x in kv]), predicate)
    ends = F.coalesce(*[F.when((topic == k) | topic.endswith(f".{k}") | topic.endswith(f":{k}"), F.lit(v)) for k, v in L.STACK_FIELDS.items()])
    words = F.lower(F.concat_ws(" ", F.coalesce("value", F.lit("")), F.coalesce("content", F.lit(""))))
    found = F.coalesce(named, ends, first_match(words, L.STACK_VALUES, F.lit(None)))
    return F.when((predicate != "") & ~predicate.startswith("disliked_") & ~predicate.startswith("favorite_"), found)


def cluster_topic() -> Column:
    topic = F.lower(F.trim(F.coalesce("topic_key", F.lit(""))))
    owner = F.when((F.lower("scope") == "user") | (F.lower("subject") == "user"), "user").otherwise("project")
    return F.when(topic.isin("user.tech_stack", "project.tech_stack"), topic).when(stack_field().isNotNull(), F.concat(owner, F.lit(".tech_stack")))


def clustered(items: DataFrame) -> DataFrame:
    """Active items with their cluster and field."""
    return items.where("status = 'active'").withColumns({"cluster": cluster_topic(), "field": stack_field()}).where("cluster is not null")


def clusters(items: DataFrame, least: int = 3) -> DataFrame:
    """(user_id, cluster, members, atomics) of clusters worth consolidating."""
    whole = F.lower("topic_key") == F.col("cluster")
    sums = clustered(items).groupBy("user_id", "cluster").agg(F.count("*").alias("members"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("atomics"))
    return sums.where((F.col("atomics") >= least) | ((F.col("atomics") >= 2) & (F.col("members") >= least)) | ((F.col("members") > F.col("atomics")) & (F.col("atomics") >= 1)))


def _by_field() -> Window:
    return Window.partitionBy("user_id", "cluster", "field")


def field_values(items: DataFrame) -> DataFrame:
    """One row for each member's field: an atomic's value, and each entry of an earlier consolidation; `position`: reading order."""
    known = clustered(items)
    whole = F.coalesce(F.lower("topic_key") == F.col("cluster"), F.lit(False))
    text = F.trim(F.coalesce(F.nullif("value", F.lit("")), F.col("content")))
    parsed = F.from_json(text, "map<string,string>")
    entries = F.when(whole & parsed.isNotNull(), F.map_entries(parsed)).otherwise(F.array(F.struct(F.col("field").alias("key"), text.alias("value"))))
    rows = known.select("user_id", "cluster", "id", "confidence", "importance", "stability", F.posexplode(entries).alias("entry", "e"))
    out = rows.select("user_id", "cluster", "id", "confidence", "importance", "stability", "entry", F.col("e.key").alias("field"), F.trim("e.value").alias("value"))
    return out.where("field is not null and value <> ''").withColumn("position", F.row_number().over(Window.partitionBy("user_id", "cluster", "field").orderBy("id", "entry")))


def winners(items: DataFrame) -> DataFrame:
    """The value of each cluster's field: the most confident, the earlier of equals."""
    w = _by_field().orderBy(F.col("confidence").desc(), "position")
    return field_values(items).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def conflicts(items: DataFrame) -> DataFrame:
    """(user_id, cluster, field, kept_before, challenger, resolution): each value that differed from the one kept until then.

    The one kept before a row is the most confident among those before it, the earlier of equals; a running maximum.
    """
    before = _by_field().orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.struct("confidence", (-F.col("position")).alias("order"), F.col("value").alias("v"), F.col("id").alias("i"))).over(before)
    rows = field_values(items).withColumn("best", best).where("best is not null and lower(best.v) <> lower(value)")
    kept = F.when(F.col("confidence") > F.col("best.confidence"), F.col("value")).otherwise(F.col("best.v"))
    return rows.select("user_id", "cluster", "field", F.col("best.i").alias("kept_id"), F.col("id").alias("challenger_id"), F.col("best.v").alias("kept_before"), F.col("value").alias("challenger"), F.concat(F.lit("kept "), kept, F.lit(" due to higher confidence")).alias("resolution"))


def consolidated(items: DataFrame) -> DataFrame:
    """One record for each qualifying cluster with at least two fields: its values as JSON, scores, and the ids that it supersedes."""
    own = clusters(items).select("user_id", "cluster")
    best = winners(items).join(own, ["user_id", "cluster"])
    sources = field_values(items).groupBy("user_id", "cluster").agg(F.array_sort(F.collect_set("id")).alias("source_ids"))
    # an item that wins several fields counts once in the mean
    once = best.withColumn("__first", F.row_number().over(Window.partitionBy("user_id", "cluster", "id").orderBy("field")))
    pairs = F.array_sort(F.collect_list(F.struct("field", "value")))
    out = once.groupBy("user_id", "cluster").agg(
        pairs.alias("pairs"), F.round(F.avg(F.when(F.col("__first") == 1, F.col("confidence"))), 3).alias("confidence"),
        F.round(F.greatest(F.lit(0.95), F.max("importance")), 3).alias("importance"), stability_score(stability_label(F.greatest(F.lit(0.85), F.max("stability")))).alias("stability"),
    )
    out = out.where(F.size("pairs") >= 2).join(sources, ["user_id", "cluster"])
    text = F.concat(F.lit("Tech Stack: "), F.array_join(F.transform("pairs", lambda p: F.concat(p["field"], F.lit("="), p["value"])), ", "))
    return out.select(
        "user_id", F.col("cluster").alias("topic_key"), F.lit("architecture").alias("type"), F.element_at(F.split("cluster", r"\."), 1).alias("scope"), F.lit("tech_stack").alias("predicate"),
        F.to_json(F.map_from_entries("pairs")).alias("value"), text.alias("content"), "confidence", "importance", "stability", F.lit(0.9).alias("information_gain"), F.lit(1.0).alias("freshness"), "source_ids",
    )


def applied(items: DataFrame, records: DataFrame) -> DataFrame:
    """The items with those that the records were made of marked as superseded."""
    gone = records.select("user_id", F.explode("source_ids").alias("id")).distinct().withColumn("__gone", F.lit(True))
    return items.join(gone, ["user_id", "id"], "left").withColumn("status", F.when(F.col("__gone"), "superseded").otherwise(F.col("status"))).drop("__gone")


def appended(items: DataFrame, records: DataFrame) -> DataFrame:
    """All items with the records as items of their own, numbered after the user's highest id, each superseding its first source."""
    top = items.groupBy("user_id").agg(F.max("id").alias("__top"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("topic_key"))
    new = records.join(top, "user_id").withColumns({
        "id": F.col("__top") + nth, "subject": F.col("scope"), "supersedes_id": F.element_at("source_ids", 1), "related_ids": F.col("source_ids"), "contradicts_ids": F.array().cast("array<long>"),
        "relationship": F.lit("supersedes"), "status": F.lit("active"), "version": F.lit(1),
    })
    return applied(items, records).unionByName(new.select(*[c for c in items.columns if c in new.columns]), allowMissingColumns=True)


#: Fixed value: what a prompt's block of memory begins with.
PROMPT_TITLE = "[Project Memory & Canonical State]\n"


def prompt_head() -> Column:
    """The title-case heading of an item's type."""
    return F.initcap(F.replace(F.coalesce("type", F.lit("fact")), F.lit("_"), F.lit(" ")))


def prompt_line() -> Column:
    """An item's line in a prompt."""
    p, v = F.trim(F.coalesce("predicate", F.lit(""))), F.trim(F.coalesce("value", F.lit("")))
    spaced = F.replace(p, F.lit("_"), F.lit(" "))
    pair = F.concat(spaced, F.lit(": "), v)
    dislikes = F.concat(F.lit("dislikes "), F.replace(F.regexp_replace(p, "^disliked_", ""), F.lit("_"), F.lit(" ")), F.lit(": "), v)
    named = p.startswith("favorite_") | p.startswith("preferred_") | (F.lower("type") == "preference") | (F.trim("content") == v)
    entry = F.when((p != "") & (v != "") & p.startswith("disliked_"), dislikes).when((p != "") & (v != "") & named, pair).otherwise(F.col("content"))
    mark = F.when(F.lower("status") == "superseded", "(previous) ").when(F.lower("status") == "revoked", "(revoked) ").otherwise("")
    return F.concat(F.lit("  - "), mark, entry)


def prompt_block(items: DataFrame) -> DataFrame:
    """(user_id, block): items grouped by type under title-case headings, as text for a prompt; the order is by id."""
    rows = items.select("user_id", "id", prompt_head().alias("head"), prompt_line().alias("line"))
    groups = rows.groupBy("user_id", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    shown = F.concat(F.lit("• "), F.col("head"), F.lit(":\n"), F.col("lines"))
    blocks = groups.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("head", shown.alias("text")))), lambda x: x["text"]), "\n").alias("text"))
    return blocks.select("user_id", F.concat(F.lit(PROMPT_TITLE), F.col("text")).alias("block"))


def rendered(items: DataFrame) -> DataFrame:
    """(user_id, context): a line `subject.predicate: value` for each item, by id."""
    v = F.coalesce(F.nullif("value", F.lit("")), F.col("content"))
    line = F.concat(F.concat_ws(".", F.nullif("subject", F.lit("")), F.nullif("predicate", F.lit(""))), F.lit(": "), v)
    return items.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def api_shape(items: DataFrame) -> DataFrame:
    """Items as the API shows them: subject as entity, predicate as attribute, blanks as null."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    return items.select("id", "user_id", full("subject").alias("entity"), full("predicate").alias("attribute"), full("value").alias("value"), "type", "scope", "status", "confidence", "importance")
