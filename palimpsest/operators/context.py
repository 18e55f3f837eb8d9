"""Short-term context and rates over tables: what holds at a moment, and how often a key has been seen."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def writes(routed: DataFrame, written_at: Column) -> DataFrame:
    """Context rows of routed candidates: user_id, key, value, written_at, expires_at."""
    own = routed.where("bucket = 'context'")
    return own.select("user_id", F.col("context_key").alias("key"), F.col("content").alias("value"), written_at.alias("written_at"), (written_at + F.make_dt_interval(secs=F.col("ttl_seconds"))).alias("expires_at"))


def live(entries: DataFrame, as_of: datetime) -> DataFrame:
    """The last value of each user's key, if it holds at the moment, and for how many seconds more."""
    last = entries.where(F.col("written_at") <= F.lit(as_of)).groupBy("user_id", "key").agg(F.max_by(F.struct("value", "written_at", "expires_at"), F.struct("written_at", "value")).alias("x"))
    rows = last.select("user_id", "key", "x.*").where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of)))
    left = F.greatest(F.lit(0), F.round((F.unix_micros(F.col("expires_at").cast("timestamp")) - F.unix_micros(F.lit(as_of))) / 1e6)).cast("long")
    return rows.withColumn("remaining_seconds", left)


def without(entries: DataFrame, deletions: DataFrame) -> DataFrame:
    """Entries whose key (user_id, key; a null key: all of the user's) has not been deleted."""
    keyed = deletions.where("key is not null").select("user_id", "key").distinct()
    whole = deletions.where("key is null").select("user_id").distinct()
    return entries.join(keyed, ["user_id", "key"], "left_anti").join(whole, "user_id", "left_anti")


def window_counts(events: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = 60) -> DataFrame:
    """Adds `in_window`: the key's events of the last `seconds`, its own included; one exactly that old has left."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("in_window", F.count("*").over(w))
