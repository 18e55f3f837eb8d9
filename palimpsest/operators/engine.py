"""The whole pass over a batch of requests: users, archive, extraction with supplied model output, fold, obsolete items, snapshots, consolidation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.facts import FACT
from palimpsest.operators import consolidate, context, dependencies, extract, fold, messages, model, retrieve
from palimpsest.sources.schemas import CONTEXT_VERSIONS, ITEM, USERS, names
from palimpsest.sources.tables import normalized, stored

#: Where supplied candidates stand: after all that a user's messages gave.
AFTER = (1 << 31) - 1


def offered(answers: DataFrame, told: DataFrame) -> DataFrame:
    """Candidates of supplied model answers (user_id, answer) in the layout of `extract.candidates`, after those in `told`.

    One whose content, whatever its case, is there already is left out, among the supplied ones the first stays.
    """
    rows = model.as_candidates(model.ai_candidates(answers), F.lit(None).cast("timestamp"))
    turn = F.row_number().over(Window.partitionBy("user_id", F.lower("content")).orderBy("n"))
    rows = model.not_present(rows.withColumn("__turn", turn).where("__turn = 1").drop("__turn"), told)
    none = lambda t: F.lit(None).cast(t)
    fact = F.struct(
        F.col("subject").alias("entity"), F.col("predicate").alias("attribute"), F.col("value").alias("value"), F.col("type").alias("memory_type"), F.col("topic_key").alias("fact_key"),
        F.col("scope").alias("scope"), none("string").alias("preferred_over"), F.col("is_correction").alias("is_update"),
    ).cast(FACT)
    key = F.concat(F.lit("model:"), F.sha2(F.concat_ws("|", "user_id", F.lower("content")), 256))
    return rows.select(
        "user_id", key.alias("message_key"), F.lit(AFTER).alias("ordinal"), F.col("n").cast("int").alias("sentence"), F.lit(0).alias("part"), "content", "type", "topic_key", "authority", "is_correction",
        none(dict(told.dtypes)["correction"]).alias("correction"), none(dict(told.dtypes)["revocation"]).alias("revocation"), fact.alias("fact"),
    )


def replaced(answers: DataFrame) -> DataFrame:
    """(user_id, description): what supplied candidates supersede or contradict, by id or else by their own text."""
    rows = model.ai_candidates(answers).where(F.col("action").isin("SUPERSEDES", "CONTRADICTS"))
    return rows.select("user_id", F.coalesce(F.nullif("supersedes_id", F.lit("")), F.col("raw_text")).alias("description")).where("description <> ''")


def whole_pass(requests: DataFrame, as_of: datetime, archive: DataFrame | None = None, users: DataFrame | None = None, items: DataFrame | None = None, versions: DataFrame | None = None, answers: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything a batch of requests (user_id, ordinal, role, content, ..) does to the tables, which are what was there before.

    users, messages, context, corrections, versions: rows to append. memory: all items after the pass. actions, routes: its log.
    Repeated messages are extracted again, as they may have been archived before their facts were known; the fold merges
    what it has. `answers` (user_id, answer) are supplied model output; malformed ones give nothing.
    """
    spark = requests.sparkSession
    empty = lambda layout: spark.createDataFrame([], layout)
    users = empty(USERS) if users is None else users
    versions = empty(CONTEXT_VERSIONS) if versions is None else versions
    every = stored(normalized(requests))
    archive = every.limit(0) if archive is None else archive
    moment = F.lit(as_of).cast("timestamp")

    told = extract.candidates(every)
    layout = ["user_id", "message_key", "ordinal", "sentence", "part", "content", "type", "topic_key", "authority", "is_correction", "correction", "revocation", "fact"]
    told = stored(told.select(*layout))
    if answers is not None:
        told = told.unionByName(offered(answers, told))
    told = stored(extract.routed(told))
    ready = fold.prepared(dependencies.numbered(told.where("bucket = 'store'"), ["ordinal", "sentence", "part"]), [], moment)
    rows = stored(dependencies.folded(ready, items))
    actions, memory = fold.actions(rows), fold.state(rows)

    changed = consolidate.changed(actions).where("changed").select("user_id")
    if answers is not None:
        gone = stored(retrieve.obsolete(memory, replaced(answers)).select("user_id", "id"))
        memory = memory.join(gone.withColumn("__gone", F.lit(True)), ["user_id", "id"], "left")
        memory = memory.withColumns({"status": F.when(F.col("__gone"), "obsolete").otherwise(F.col("status")), "updated_at": F.when(F.col("__gone"), moment).otherwise(F.col("updated_at"))}).select(*names(ITEM))
        changed = changed.unionByName(gone.select("user_id")).distinct()
    memory = stored(memory)
    first = stored(consolidate.next_version(memory.join(changed, "user_id", "left_semi"), versions, moment))

    here = every.select("user_id").distinct()
    made = stored(consolidate.consolidated(memory.join(here, "user_id", "left_semi")))
    after = stored(consolidate.appended(memory, made).select(*names(ITEM)))
    known = versions.select("user_id", "version").unionByName(first.select("user_id", "version"))
    second = consolidate.next_version(after.join(made.select("user_id").distinct(), "user_id", "left_semi"), known, moment)
    return {
        "users": messages.new_users(every, users).withColumn("created_at", moment), "messages": messages.delta(every, archive), "memory": after, "actions": actions,
        "corrections": fold.corrections(rows), "context": context.writes(told, moment), "versions": first.unionByName(second), "routes": told.groupBy("user_id", "bucket").agg(F.count("*").alias("n")),
    }
