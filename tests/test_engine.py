"""The whole pass over batches: idempotent delivery, supplied answers, large users, writes that fail half way, and process."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest import api
from palimpsest.operators import dependencies, engine, fold
from palimpsest.plans import golden
from palimpsest.sources.schemas import ITEM
from palimpsest.streaming import writes
from test_dependencies import READY, candidates, rows_of

NOW = datetime(2024, 1, 20)
KIND = "user_id string, ordinal int, role string, content string"
SCRIPT = [(u, i, "user", s) for u, said in golden.SCRIPT for i, s in enumerate(said)]


def test_a_second_delivery_changes_no_contents(spark):
    rows = spark.createDataFrame(SCRIPT, KIND)
    first = engine.whole_pass(rows, NOW)
    assert first["users"].count() == 3 and first["messages"].count() == len(SCRIPT)
    again = engine.whole_pass(rows.where("user_id = 'c'"), NOW, first["messages"], first["users"], first["memory"], first["versions"])
    assert again["users"].isEmpty() and again["messages"].isEmpty()
    held = lambda f: sorted((r.user_id, r.content) for r in f.where("status = 'active'").collect())
    # c's first sentence is told again, then corrected again, as the published pass does
    assert held(again["memory"]) == held(first["memory"])
    assert {r.user_id: r.version for r in again["versions"].collect()} == {"c": 2}


def test_answers_that_are_malformed_or_known(spark):
    rows = spark.createDataFrame([("u", 0, "user", "P uses Neon for database")], KIND)
    answers = [("u", "no json"), ("u", '{"candidates":[{"action":"NEW","predicate":"x","value":"y","rawText":"DATABASE: neon FOR database"}]}'), ("v", '{"candidates":[{"predicate":"editor","value":"Helix"}]}'), (None, None)]
    got = engine.whole_pass(rows, NOW, answers=spark.createDataFrame(answers, "user_id string, answer string"))
    assert {(r.user_id, r.content, r.status) for r in got["memory"].collect()} == {("u", "Database: Neon for database", "active"), ("v", "editor: Helix", "active")}


def test_empty_batch(spark):
    got = engine.whole_pass(spark.createDataFrame([], KIND), NOW)
    assert all(f.isEmpty() for f in got.values())


def test_large_users_are_split(spark):
    import random

    ready = spark.createDataFrame(candidates(random.Random(4), ["a"], 60) + candidates(random.Random(5), ["b"], 10), READY)
    assert rows_of(dependencies.folded(ready, most=30)) == rows_of(fold.fold(ready))


def test_consolidation_takes_an_earlier_record_in(spark):
    said = [("u", i, "user", s) for i, s in enumerate(["I use TypeScript", "My project uses Hono for framework", "The database is Neon"])]
    first = engine.whole_pass(spark.createDataFrame(said, KIND), NOW)
    more = [("u", i, "user", s) for i, s in enumerate(["The database is Turso", "The runtime is Bun", "The cache is Redis", "The hosting is Fly"])]
    second = engine.whole_pass(spark.createDataFrame(more, KIND), NOW, first["messages"], first["users"], first["memory"], first["versions"])
    records = second["memory"].where("type = 'architecture' and predicate = 'tech_stack'").orderBy("id").collect()
    assert records and records[-1].status == "active" and "Turso" in records[-1].content
    ids = [r.id for r in second["memory"].collect()]
    assert len(ids) == len(set(ids))


def test_process(spark):
    done = api.process(spark.createDataFrame(SCRIPT, KIND), spark.createDataFrame(SCRIPT, KIND).limit(0).withColumn("message_key", F.lit("")), None, None, NOW, budget=400)
    found = {(r.user_id, r.content) for r in done["found"].collect()}
    # a's last sentence asks for what was before, b's does not
    assert {("a", "blue"), ("a", "red"), ("b", "light theme"), ("c", "Database: Turso")} <= found and ("b", "dark theme") not in found
    sent = done["sent"].where("user_id = 'c'").orderBy("position").collect()
    assert sent[-1].content == "We switched P to Turso for the database." and "Turso" in sent[0].content
    assert {r.user_id for r in done["rendered"].collect()} == {"a", "b", "c"}


LAYOUT = "user_id string, content string"


def test_a_batch_counts_once_and_whole(spark, tmp_path):
    root = str(tmp_path / "w")
    rows = lambda *x: spark.createDataFrame([("u", c) for c in x], LAYOUT)
    assert writes.commit(spark, root, 0, {"messages": rows("a", "b"), "memory": rows("m")})
    # a replay of a batch that counts, with other rows, changes nothing
    assert not writes.commit(spark, root, 0, {"messages": rows("z"), "memory": rows("z")})
    # a batch that fails between two writes is not there
    bad = rows("n").withColumn("content", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        writes.commit(spark, root, 1, {"messages": rows("c"), "memory": bad})
    read = lambda t: sorted(r.content for r in writes.read(spark, root, t, LAYOUT).collect())
    assert read("messages") == ["a", "b"] and read("memory") == ["m"]
    # its replay is written once
    assert writes.commit(spark, root, 1, {"messages": rows("c"), "memory": rows("n")})
    assert read("messages") == ["a", "b", "c"] and read("memory") == ["m", "n"]
    assert {(r.batch, r.table, r.rows) for r in writes.committed(spark, root).collect()} == {(0, "messages", 2), (0, "memory", 1), (1, "messages", 1), (1, "memory", 1)}
    assert [r.content for r in writes.latest(writes.read(spark, root, "memory", LAYOUT), "user_id").collect()] == ["n"]


def test_a_stream_of_batches_is_the_batches(spark, tmp_path):
    """`foreachBatch` over the script, a sentence of each user a batch, leaves what one pass after another leaves."""
    root, source = str(tmp_path / "w"), tmp_path / "s"
    batches = [[r for r in SCRIPT if r[1] // 4 == k] for k in range(2)]
    batches = [b for b in batches if b]
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{source}/part={i}")
        for f in (source / f"part={i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")

    def work(rows):
        memory = writes.latest(writes.read(rows.sparkSession, root, "memory", ITEM), "user_id", "id").drop("batch")
        got = engine.whole_pass(rows, NOW, items=memory)
        return {"messages": got["messages"], "memory": got["memory"]}

    q = stream.writeStream.foreachBatch(writes.sink(root, work)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(400)
    memory = None
    for rows in batches:
        memory = engine.whole_pass(spark.createDataFrame(rows, KIND), NOW, items=memory)["memory"]
    shown = lambda f: sorted((r.user_id, r.id, r.content, r.status, r.version) for r in f.collect())
    assert shown(writes.latest(writes.read(spark, root, "memory", ITEM), "user_id", "id")) == shown(memory)
    assert writes.committed(spark, root).select("batch").distinct().count() == len(batches)
