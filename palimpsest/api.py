"""The service's functions as functions over tables: ingest, search, save, update, forget, compile."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.facts import content_of, fact, topic_of
from palimpsest.functions.text import slug
from palimpsest.operators import compile as packing
from palimpsest.operators import consolidate, context, dependencies, engine, fold, retrieve

TYPES = ["fact", "decision", "constraint", "preference", "goal", "architecture", "important_event", "active_task", "temporary_state"]


def memory_type(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit("fact"))))
    return F.when(low.isin(TYPES), low).otherwise("fact")


def ingest(new: DataFrame, archive: DataFrame, items: DataFrame | None, as_of: datetime, **known: DataFrame | None) -> dict[str, DataFrame]:
    """The whole pass over new messages: what to append to the archive, the memory that results, its log, and the context to write.

    `known`: users, versions and supplied model answers, as `engine.whole_pass` takes them.
    """
    return engine.whole_pass(new, as_of, archive, items=items, **known)


def save_candidates(rows: DataFrame) -> DataFrame:
    """Rows to save (user_id, subject, attribute, value, type, scope, authority) as candidates; a blank value saves nothing."""
    get = lambda n, d: F.coalesce(F.nullif(F.trim(n), F.lit("")), F.lit(d)) if n in rows.columns else F.lit(d)
    value, subject, attribute = F.trim("value"), get("subject", "user"), get("attribute", "")
    kind = memory_type(F.col("type")) if "type" in rows.columns else F.lit("fact")
    scope = F.coalesce(get("scope", None), F.when(F.lower(subject) == "user", "user").otherwise("project"))
    f = fact(subject, F.when(attribute == "", "item").otherwise(attribute), value, kind, F.lit(None), F.lit(None))
    bare = (kind == "preference") & (attribute == "")
    none = lambda t: F.lit(None).cast(t)
    return rows.where(value != "").select(
        "user_id", F.when(bare, value).otherwise(content_of(f)).alias("content"), kind.alias("type"), F.when(bare, F.concat(F.lit("preference:"), slug(value))).otherwise(topic_of(f)).alias("topic_key"),
        get("authority", "user").alias("authority"), F.lit(False).alias("is_correction"), subject.alias("subject"), attribute.alias("predicate"), value.alias("value"), scope.alias("scope"),
        none("struct<target:string,old_value:string,new_value:string>").alias("correction"), none("struct<target:string,value:string>").alias("revocation"),
        F.concat(F.lit("manual:"), F.sha2(F.concat_ws("|", "user_id", "value"), 256)).alias("message_key"),
    )


def save(rows: DataFrame, items: DataFrame | None) -> DataFrame:
    """The fold's rows after saving."""
    return dependencies.folded(fold.prepared(save_candidates(rows), ["message_key"]), items)


def update(items: DataFrame, changes: DataFrame, as_of: Column | None = None) -> DataFrame:
    """All items after changes (user_id, id or topic_key, value): the active one named is superseded by a new version.

    New ids follow the user's highest. Changes that name no active item are left to `save`; two that name the same are an error.
    `as_of`: when that happens, where the items have these columns.
    """
    named = changes.select("user_id", F.col("id").alias("want_id") if "id" in changes.columns else F.lit(None).cast("long").alias("want_id"), F.lower(F.trim("topic_key")).alias("want_topic") if "topic_key" in changes.columns else F.lit(None).cast("string").alias("want_topic"), F.trim("value").alias("new_value"))
    hit = items.where("status = 'active'").join(named.where("new_value <> ''"), "user_id").where(F.coalesce(F.col("id") == F.col("want_id"), F.lower("topic_key") == F.col("want_topic")))
    twice = F.count("*") > 1
    hit = hit.groupBy("user_id", "id").agg(F.when(twice, F.raise_error(F.lit("several changes name one item"))).otherwise(F.max("new_value")).alias("new_value"))
    top = items.groupBy("user_id").agg(F.max("id").alias("top"))
    none = lambda t: F.lit(None).cast(t)
    marked = items.join(hit, ["user_id", "id"], "left")
    gone, moment = F.col("new_value").isNotNull(), none("timestamp") if as_of is None else as_of.cast("timestamp")
    there = lambda *c: [x for x in c if x in items.columns]
    old = marked.withColumns({"status": F.when(gone, "superseded").otherwise(F.col("status"))} | {c: F.when(gone, F.coalesce(moment, c)).otherwise(F.col(c)) for c in there("updated_at")}).drop("new_value")
    fresh = marked.where("new_value is not null").join(top, "user_id")
    f = fact(F.coalesce(F.nullif("subject", F.lit("")), F.lit("user")), F.coalesce(F.nullif("predicate", F.lit("")), F.lit("item")), F.col("new_value"), F.col("type"), F.lit(None), F.col("scope"))
    fresh = fresh.withColumns({
        "supersedes_id": F.col("id"), "id": F.col("top") + F.row_number().over(Window.partitionBy("user_id").orderBy("id")), "content": content_of(f), "value": F.col("new_value"),
        "version": F.col("version") + 1, "confidence": F.lit(0.95), "importance": F.greatest("importance", F.lit(0.8)), "stability": F.lit(0.6), "freshness": F.lit(1.0), "information_gain": F.lit(0.85),
    } | {c: moment for c in there("created_at", "updated_at")} | {c: none(dict(items.dtypes)[c]) for c in there("valid_from", "valid_until", "relationship", "contradicts_ids", "related_ids")})
    return old.select(*items.columns).unionByName(fresh.select(*items.columns))


def forget(items: DataFrame, **what) -> DataFrame:
    """All items after the active ones named are revoked."""
    gone = retrieve.forget_targets(items, **what).select("user_id", "id").withColumn("__gone", F.lit(True))
    return items.join(gone, ["user_id", "id"], "left").withColumn("status", F.when(F.col("__gone"), "revoked").otherwise(F.col("status"))).drop("__gone")


def compare_and_swap(items: DataFrame, id: int, expected: int, patch: dict) -> DataFrame:
    """All items, the one with this id and version patched and its version raised; unchanged if the version differs."""
    hit = (F.col("id") == id) & (F.col("version") == expected)
    out = items.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in patch.items()})
    return out.withColumn("version", F.when(hit, F.col("version") + 1).otherwise(F.col("version")))


def consolidate_all(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new records, all items after them: the records appended, their sources superseded by them)."""
    made = consolidate.consolidated(items)
    return made, consolidate.appended(items, made)


def compile_context(requests: DataFrame, items: DataFrame | None = None, budget: int = 8000, entries: DataFrame | None = None, as_of: datetime | None = None) -> dict[str, DataFrame]:
    """The messages to send, what was selected, and statistics; `entries` of short-term context count if they hold at `as_of`."""
    return packing.compiled_parts(requests, items, budget, context.live(entries, as_of) if entries is not None else None)


def process(new: DataFrame, archive: DataFrame, items: DataFrame | None, entries: DataFrame | None, as_of: datetime, budget: int = 8000, **known: DataFrame | None) -> dict[str, DataFrame]:
    """Ingests requests, searches the memory that results for each one's last user text, and compiles the requests with it.

    `found`: at most 20 items a user, of those that the text calls for, `rendered`: they as lines; `sent`, `statistics`: the compiled request.
    """
    done = ingest(new, archive, items, as_of, **known)
    held = done["context"] if entries is None else entries.unionByName(done["context"])
    query = packing.query_words(new)
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc()))
    found = packing.retrieved(done["memory"], query).withColumn("__n", turn).where("__n <= 20").drop("__n")
    sent = compile_context(new, done["memory"], budget, held, as_of)
    return done | {"found": found, "rendered": consolidate.rendered(found), "sent": sent["messages"], "statistics": sent["statistics"]}


search = retrieve.search
