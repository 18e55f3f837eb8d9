"""Postings find what the plain search finds and read less; long values come whole; composed forms at the gates."""

import os
import random

from pyspark.sql import functions as F

from palimpsest.functions import facts
from palimpsest.operators import extract, postings, retrieve
from palimpsest.sources.tables import normalized

WORDS = "neon turso postgres redis kafka hono astro bun deno rust mocha latte".split()
ITEM = "user_id string, id long, content string, value string, predicate string, subject string, topic_key string, status string, importance double"


def items(spark, n=400):
    rng = random.Random(3)
    one = lambda: rng.choice([None, "", "ab", *[" ".join(rng.choices(WORDS, k=rng.randrange(1, 4))) for _ in range(4)]])
    return spark.createDataFrame([(rng.choice(["u", "v"]), i, one(), one(), one(), "user", one(), rng.choice(["active", "revoked"]), 0.5) for i in range(n)], ITEM)


def test_same_rows_as_the_plain_search(spark, tmp_path):
    m = items(spark)
    path = str(tmp_path / "p")
    postings.write(m, path)
    table = spark.read.parquet(path)
    for terms in (["neon"], ["so pos", "kafka"], ["nowhere"], ["ab"], ["rust", "b"], [], ["  "], ["user"], ["latte latte latte latte"]):
        got = {(r.user_id, r.id) for r in postings.search(m, table, terms).collect()}
        kept = [t.strip() for t in terms if t.strip()]
        want = {(r.user_id, r.id) for r in m.collect() if any(t in (r[c] or "") for t in kept for c in postings.FIELDS)}
        assert got == want
    active = {(r.user_id, r.id) for r in postings.search(m.where("status = 'active'"), table, ["neon", "kafka"]).collect()}
    assert active == {(r.user_id, r.id) for r in retrieve.search(m, "neon kafka", limit=None).collect()}


def test_a_selective_term_reads_few_folders(spark, tmp_path):
    path = str(tmp_path / "p")
    postings.write(items(spark), path)
    table = spark.read.parquet(path)
    plan = postings.wanted(table, ["neo"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [(folder" in plan and "PushedFilters" in plan
    folders = {r.folder for r in table.where(F.col("gram") == "neo").select("folder").collect()}
    assert len(folders) == 1 < len([x for x in os.listdir(path) if x.startswith("folder=")])


def test_long_values_come_whole(spark):
    value = "Zig " + "y" * 150_000
    said = [(0, f"[decision] {value}"), (1, f"I prefer use {value} over Go")]
    rows = spark.createDataFrame(said, "i int, s string")
    body = rows.where("i = 0").select(facts.classified(F.col("s")).alias("c")).first().c.body
    assert body == value
    chosen = rows.where("i = 1").select(facts.preference(F.col("s")).alias("f")).first().f
    assert chosen.value == value
    f = facts.fact(F.lit("user"), F.lit("k" * 20_000), F.lit("v"), F.lit("fact"), F.lit(None), F.lit(None))
    assert spark.range(1).select(facts.content_of(f).alias("c")).first().c == "K" + "k" * 19_999 + ": v"


def test_compatibility_forms_say_nothing_too(spark):
    said = ["ｏｋ", "ok", "ｔhanks", "P uses Neon for database"]
    m = normalized(spark.createDataFrame([("u", i, "user", s) for i, s in enumerate(said)], "user_id string, ordinal int, role string, content string"))
    assert [r.content for r in extract.gated(m).collect()] == ["P uses Neon for database"]
