"""The fold and the knapsack against plain models, similarity against its table, and the API's functions."""

import random
from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest import api
from palimpsest.functions import scoring
from palimpsest.operators import compile as packing
from palimpsest.operators import fold, retrieve
from palimpsest.plans import golden
from palimpsest.sources.tables import normalized


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abcé ", max_size=40), st.text("abcé ", max_size=40))
def test_lcs(a, b):
    assert scoring.lcs_length(a, b) == table_lcs(a, b)


@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 20)), max_size=9), st.integers(0, 30))
@settings(max_examples=150)
def test_knapsack_is_exact(items, capacity):
    cost, value = np.array([x for x, _ in items], int), np.array([y / 4 for _, y in items])
    chosen = packing.knapsack(cost, value, capacity)
    assert cost[chosen].sum() <= max(0, capacity)
    best = 0
    for mask in range(1 << len(items)):
        pick = [i for i in range(len(items)) if mask >> i & 1]
        if cost[pick].sum() <= capacity:
            best = max(best, value[pick].sum()) if pick else best
    assert len(items) == 0 or abs(value[chosen].sum() - best) < 1e-9


def test_knapsack_greedy_beyond_the_table():
    cost, value = np.full(5000, 100), np.linspace(0, 1, 5000)
    chosen = packing.knapsack(cost, value, 1000)
    assert len(chosen) == 10 and chosen.min() == 4990


def candidate(seq, content, kind="decision", topic="t", **more):
    return {
        "user_id": "u", "seq": seq, "content": content, "type": kind, "topic_key": topic, "authority": "user", "is_correction": False, "subject": "p", "predicate": "q", "value": content,
        "scope": "project", "confidence": 0.9, "importance": 0.9, "stability": 0.5, "freshness": 1.0, "source_message_ids": [f"m{seq}"], "old_value": None, "new_value": None,
        "revoked_target": None, "revoked_value": "",
    } | more


def test_step_rules():
    items = []
    assert fold.step(items, candidate(1, "Database: Neon"), 1)[0] == "create"
    assert fold.step(items, candidate(2, "Database: Neon"), 2)[0] == "merge"
    assert items[0]["version"] == 2 and items[0]["source_message_ids"] == ["m1", "m2"]
    assert fold.step(items, candidate(3, "Database: Turso cloud"), 2)[:2] == ("supersede", "topic_contradiction")
    assert fold.step(items, candidate(4, "Perhaps Oracle", authority="speculation", confidence=0.5), 3)[0] == "reject"
    assert fold.step(items, candidate(5, "x", old_value="turso", new_value="Bun"), 3)[:2] == ("supersede", "correction")
    assert fold.step(items, candidate(6, "REVOKE", revoked_target="nothing known"), 4)[0] == "skip"
    assert fold.step(items, candidate(7, "REVOKE", revoked_target="database", revoked_value="x"), 4)[0] == "revoke"
    assert {i["status"] for i in items} == {"superseded", "revoked"}


def test_fold_keeps_its_invariants():
    rng = random.Random(5)
    for _ in range(50):
        items = []
        for seq in range(1, 25):
            word = rng.choice(["neon", "turso", "sqlite file", "postgres", "redis cache"])
            fold.step(items, candidate(seq, f"Item: {word} {rng.randrange(3)}", topic=rng.choice(["a", "b"])), len(items) + 1)
        ids = [i["id"] for i in items]
        assert len(ids) == len(set(ids))
        active = [i["topic_key"] for i in items if i["status"] == "active"]
        assert len(active) == len(set(active))
        assert all(i["supersedes_id"] is None or i["supersedes_id"] < i["id"] for i in items)


def script(spark):
    rows = [(u, i, "user", s) for u, said in golden.SCRIPT for i, s in enumerate(said)]
    return spark.createDataFrame(rows, "user_id string, ordinal int, role string, content string")


def test_ingest_twice_is_once(spark):
    m = script(spark)
    empty = normalized(m).limit(0)
    first = api.ingest(m, empty, None, datetime(2024, 1, 1))
    archive = first["messages"].cache()
    memory = first["memory"].cache()
    assert archive.count() == m.count()
    active = {(r.user_id, r.content) for r in memory.where("status = 'active'").collect()}
    assert ("a", "Database: self-hosted PostgreSQL") in active and ("a", "Database: Neon for database") not in active
    second = api.ingest(m, archive, memory, datetime(2024, 1, 2))
    assert second["messages"].count() == 0


def memory_frame(spark):
    rows = [("u", 1, "Database: Neon", "fact", "project.database", "project", "database", "Neon", "project", 0.9, 0.8, 0.5, 1.0, 0.8, "active", 1, None), ("u", 2, "red", "preference", "preference:favorite_color", "user", "favorite_color", "red", "user", 0.9, 0.7, 0.5, 1.0, 0.8, "active", 1, None)]
    return spark.createDataFrame(rows, "user_id string, id long, content string, type string, topic_key string, subject string, predicate string, value string, scope string, confidence double, importance double, stability double, freshness double, information_gain double, status string, version int, supersedes_id long")


def test_update_and_forget(spark):
    items = memory_frame(spark)
    changed = api.update(items, spark.createDataFrame([("u", "project.database", "Turso")], "user_id string, topic_key string, value string"))
    rows = {r.id: r for r in changed.collect()}
    assert rows[1].status == "superseded" and rows[3].supersedes_id == 1 and rows[3].content == "Database: Turso" and rows[3].version == 2 and rows[2].status == "active"
    gone = {r.id: r.status for r in api.forget(items, attribute="Favorite_Color").collect()}
    assert gone == {1: "active", 2: "revoked"}
    swapped = {r.id: (r.value, r.version) for r in api.compare_and_swap(items, 1, 1, {"value": "X"}).collect()}
    assert swapped == {1: ("X", 2), 2: ("red", 1)}
    assert {r.version for r in api.compare_and_swap(items, 1, 9, {"value": "X"}).collect()} == {1}


def test_save(spark):
    rows = spark.createDataFrame([("u", "user", "name", "Ada", "fact"), ("u", None, None, "tea", "preference"), ("u", None, None, " ", "fact")], "user_id string, subject string, attribute string, value string, type string")
    got = {(r.content, r.topic_key, r.scope) for r in api.save_candidates(rows).collect()}
    assert got == {("Name: Ada", "user.name", "user"), ("tea", "preference:tea", "user")}


def test_budget_holds_for_optional_items(spark):
    said = [("u", i, "user", f"message number {i} about databases and caching") for i in range(30)]
    m = spark.createDataFrame(said, "user_id string, ordinal int, role string, content string")
    chosen = packing.selected(packing.message_items(m), 120)
    r = chosen.agg(F.sum("token_cost").alias("n"), F.max("ordinal").alias("last")).first()
    assert r.n <= 120 and r.last == 29


def test_filters_reach_the_scan(spark, tmp_path):
    memory_frame(spark).write.parquet(str(tmp_path / "m"))
    plan = retrieve.matching(spark.read.parquet(str(tmp_path / "m")), predicate="database", keyword="Neon").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(predicate,database)" in plan and "scope" not in plan.split("ReadSchema")[1].split("\n")[0]
