"""Streams give what their batch forms give."""

import os
import random
from datetime import datetime, timedelta

from palimpsest.operators import extract, fold
from palimpsest.plans import golden
from palimpsest.sources.tables import normalized
from palimpsest.streaming import state, streams
from test_dependencies import READY, candidates

T0 = datetime(2024, 1, 1)


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def as_stream(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_once(spark, tmp_path):
    rows = [("u", "k1", T0), ("u", "k1", T0 + timedelta(minutes=1)), ("u", "k2", T0)]
    s = as_stream(spark, spark.createDataFrame(rows, "user_id string, message_key string, created_at timestamp"), str(tmp_path / "m"))
    assert sorted(r.message_key for r in drained(streams.once(s), "once", "append").collect()) == ["k1", "k2"]


def test_tumbling(spark, tmp_path):
    rows = [(i % 2, T0 + timedelta(minutes=i), float(i)) for i in range(120)]
    batch = spark.createDataFrame(rows, "user_id long, ts timestamp, value double")
    got = drained(streams.tumbling(as_stream(spark, batch, str(tmp_path / "e")), "user_id", "10 minutes", "0 seconds"), "tumbling", "complete")
    assert got.groupBy().sum("n").first()[0] == 120 and got.count() == 24


def test_admission(spark, tmp_path):
    asked = spark.createDataFrame([("u", T0 + timedelta(seconds=i)) for i in range(6)] + [("u", T0 + timedelta(seconds=61))], "user_id string, ts timestamp")
    got = drained(streams.admitted(as_stream(spark, asked, str(tmp_path / "r")), limit=3), "admitted", "append").orderBy("ts").collect()
    assert [r.allowed for r in got] == [True, True, True, False, False, False, True]


ENTRY = "user_id string, key string, value string, written_at timestamp, expires_at timestamp"


def in_batches(spark, batches, path, kind):
    """A stream that reads one file of rows a micro-batch, in their order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{path}/part={i:03d}")
        for f in (path / f"part={i:03d}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def held(spark, checkpoint, name):
    """What the state store holds of a state variable."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def run(df, tmp_path, name, mode):
    place = str(tmp_path / f"checkpoint-{name}")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return df.sparkSession.table(name), place


def test_context_expires(spark, tmp_path):
    """Entries that the watermark has passed leave the state; the last write wins; keys and users are deleted."""
    m = lambda n: T0 + timedelta(minutes=n)
    batches = [
        [("u", "task", "a", m(0), m(60)), ("u", "err", "401", m(0), m(5)), ("v", "task", "x", m(0), None)],
        [("u", "task", "b", m(1), None), ("u", "task", "older", m(0), m(90)), ("w", "k", "late", m(1), m(1))],
        [("v", "err", "e", m(10), m(12)), ("v", "gone", "z", m(10), None)],  # the watermark passes the end of u's err
        [("v", "gone", None, m(30), None)],  # and of v's
        [("z", "k", "v", m(40), None), ("v", None, None, m(40), None)],
    ]
    got, place = run(state.context(in_batches(spark, batches, tmp_path / "c", ENTRY)), tmp_path, "context", "update")
    told = [(r.user_id, r.key, r.value) for r in got.collect()]
    assert ("u", "err", "401") in told and ("u", "err", None) in told and ("u", "task", "b") in told and ("u", "task", "older") not in told
    assert ("v", "err", None) in told and ("v", "gone", None) in told and ("v", "task", None) in told
    kept = {(r.key.user_id if "user_id" in r.key else r.key[0], r.user_map_key.key, r.user_map_value.value) for r in held(spark, place, "known").collect()}
    assert kept == {("u", "task", "b"), ("z", "k", "v")}


def test_fold_equals_batch(spark, tmp_path):
    rows = [(u, i, "user", s) for u, said in golden.SCRIPT for i, s in enumerate(said)]
    m = normalized(spark.createDataFrame(rows, "user_id string, ordinal int, role string, content string"))
    ready = fold.prepared(extract.routed(extract.candidates(m)).where("bucket = 'store'"), ["ordinal", "sentence", "part"])
    ready.write.parquet(str(tmp_path / "p"))
    batch = spark.read.parquet(str(tmp_path / "p"))
    want = {tuple(r) for r in fold.actions(fold.fold(batch)).select("user_id", "seq", "action").collect()}
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "p"))
    got = {tuple(r) for r in drained(state.folded(stream), "folded", "append").select("user_id", "seq", "action").collect()}
    assert got == want and want


def test_fold_over_many_batches(spark, tmp_path):
    """A candidate a batch gives what the batch fold gives, and the state holds the active items alone."""
    rows = candidates(random.Random(11), ["a", "b"], 24)
    ready = spark.createDataFrame(rows, READY)
    done = fold.fold(ready)
    want = {tuple(r) for r in fold.actions(done).select("user_id", "seq", "action", "id").collect()}
    batches = [[r for r in rows if (r[1] - 1) // 3 == i] for i in range(8)]
    got, place = run(state.folded(in_batches(spark, batches, tmp_path / "f", READY)), tmp_path, "many", "append")
    assert {tuple(r) for r in got.select("user_id", "seq", "action", "id").collect()} == want
    active = {(r.user_id, r.type, r.id, r.content, r.confidence) for r in fold.state(done).where("status = 'active'").collect()}
    kept = {(r.key[0], r.user_map_key.type, r.user_map_key.id, r.user_map_value.content, r.user_map_value.confidence) for r in held(spark, place, "items").collect()}
    assert kept == active
