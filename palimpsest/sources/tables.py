"""Reading and writing: requests, messages and the driver's tables seen as messages and memory items."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import client_id, content_hash, message_key

#: Which memory type stands for an event's type in the adapter.
EVENT_TYPES = {"click": "fact", "error": "temporary_state", "purchase": "decision", "signup": "preference", "view": "important_event"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where each row is much work (extraction takes a millisecond or two a message); a folder's few small files would be few tasks.
HEAVY_ROWS = 1024


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The same rows dealt to tasks of about HEAVY_ROWS; `rows`: how many there are.

    A given number of tasks is one that Spark doesn't merge for their few bytes; the generator keeps what is computed of
    the rows, filters too, from moving to the few tasks before.
    """
    n = -(-rows // HEAVY_ROWS)
    return df.repartition(n).select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns])))) if n > 1 else df


def spread_by(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by key to all shuffle partitions of the session, for groups that are much work for their bytes: none are merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the conversations, dealt for heavy work."""
    c = read(spark, sf_dir, "conversations")
    return spread(c, c.count())  # of the files' footers


def write(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Parquet, dealt by the user's hash and sorted by status and topic within files, so that filters prune."""
    cols = [c for c in ("status", "topic_key") if c in df.columns]
    dealt = df.withColumn("user_bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    dealt.repartition("user_bucket").sortWithinPartitions("user_bucket", *cols).write.mode("append").partitionBy("user_bucket").parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder of `spark.checkpoint.dir`, so that a lost executor costs no recomputation.

    Where that is unset and Spark runs in this process alone, as in tests, a temporary folder serves; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def request_messages(requests: DataFrame, body: str = "body") -> DataFrame:
    """(other columns, ordinal, role, content, id, message_id, tool_call_id, name): messages of JSON request bodies.

    A body's `messages` come first, else its `input`, an array or a string; plain strings are a user's messages.
    """
    one = "struct<role:string,content:string,id:string,message_id:string,tool_call_id:string,name:string>"
    parsed = F.from_json(F.col(body), f"struct<messages:array<{one}>,input:string>")
    text = F.from_json(parsed["input"], "array<string>")
    made = lambda c: F.from_json(F.when(c.startswith("{"), c).otherwise(F.to_json(F.struct(F.lit("user").alias("role"), c.alias("content")))), one)
    whole = F.when(parsed["input"].isNotNull(), F.array(made(F.to_json(F.struct(F.lit("user").alias("role"), parsed["input"].alias("content"))))))
    rows = F.coalesce(parsed["messages"], F.when(parsed["input"].startswith("["), F.transform(text, made)), whole)
    keep = [c for c in requests.columns if c != body]
    return requests.select(*keep, F.posexplode(rows).alias("ordinal", "m")).select(*keep, "ordinal", "m.*").withColumn("role", F.coalesce(F.nullif("role", F.lit("")), F.lit("user")))


def normalized(messages: DataFrame) -> DataFrame:
    """Adds client_message_id, content_hash and message_key to messages (user_id, ordinal, role, content, and ids if any)."""
    col = lambda n: F.col(n) if n in messages.columns else F.lit(None).cast("string")
    client = client_id(col("id").cast("string"), col("message_id"), col("tool_call_id"))
    out = messages.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("client_message_id", client)
    ordinal = F.when(F.col("client_message_id").isNull(), F.col("ordinal"))
    out = out.withColumn("content_hash", content_hash(F.col("role"), F.col("content"), ordinal))
    return out.withColumn("message_key", message_key(F.col("role"), F.col("content"), F.col("ordinal"), F.col("client_message_id")))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as messages, one request each."""
    c = conversations(spark, sf_dir)
    return c.select(F.col("conv_id").cast("string").alias("user_id"), F.col("turn").cast("int").alias("ordinal"), "role", F.col("text").alias("content"))


def _typed(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv]), c)


def event_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as memory items: a chain of versions for each user and event type, the last active, each linked to the one before."""
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k")
    kind = _typed(F.col("event_type"))
    scope = F.when(kind == "preference", "user").otherwise("project")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.concat_ws(": ", "event_type", k).alias("content"), kind.alias("type"),
        F.concat(F.lit("event."), "event_type").alias("topic_key"), scope.alias("subject"), F.col("event_type").alias("predicate"), k.alias("value"), scope.alias("scope"),
        ((F.col("event_id") * 37) % 100 / 100.0).alias("confidence"), ((F.col("event_id") * 7) % 100 / 100.0).alias("importance"), ((F.col("event_id") * 13) % 100 / 100.0).alias("stability"),
        F.lit(1.0).alias("freshness"), F.lit(0.85).alias("information_gain"), F.lag("event_id").over(w).alias("supersedes_id"),
        F.when(F.lead("event_id").over(w).isNull(), "active").otherwise("superseded").alias("status"), F.row_number().over(w).alias("version"),
        F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_until"), F.col("ts").alias("updated_at"),
    )
