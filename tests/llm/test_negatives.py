"""Hard negatives against brute force, with ties, copies, odd values, and lists cut into blocks."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score int, list string, key long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x", 5) for i, v, y in rows], SCHEMA)


def brute(rows):
    seen = set()
    for i, v, y in rows:
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen.add((i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    for i, y, v in seen:
        if i is None or i % 100:
            continue
        score = [(sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, z, w in seen if (j, z, w) != (i, y, v)]
        for p, j, _ in sorted((s for s in score if s[2] == y and s[1] != i), key=rank)[:5]:
            found = sorted((s for s in score if s[2] != y and 80 * p <= 100 * s[0] <= 100 * p), key=rank)[:5]
            out += [(i, j, n + 1, k, p, s) for n, (s, k, _) in enumerate(found)]
    return sorted(out, key=str)


def planted(seed, n=400, dims=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [round(x + rng.gauss(0, 0.2), 1) for x in c], rng.randrange(4)))  # many ties
    copies = [(n + i, rows[0][1], rng.randrange(3)) for i in range(120)]  # a hot group of copies
    odd = [
        (900, None, 1), (901, [0.1] * dims, None), (902, [float("nan")] + [0.1] * (dims - 1), 1), (903, [float("inf")] + [0.1] * (dims - 1), 1), (904, [None] + [0.1] * (dims - 1), 1),
        (905, [0.3, 0.2], 1), (906, [], 2), (1000, [0.0] * dims, 1), (1100, [-x for x in rows[0][1]], 9), (None, rows[0][1], 1), (None, rows[1][1], 2),
    ]
    return rows + copies + odd + rows[:30]


def mined(spark, rows):
    own = negatives.prepared(frame(spark, rows))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in negatives.mined(own.withColumn("label", label), F.col("vec_id") % 100 == 0).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    rows = planted(seed)
    want = brute(rows)
    assert len(want) > 50
    assert mined(spark, rows) == want
    monkeypatch.setattr(negatives, "BLOCK", 40)  # lists of many blocks
    monkeypatch.setattr(negatives, "FIRST", 1)  # more rounds
    monkeypatch.setattr(negatives, "STEP", 3)
    assert mined(spark, rows) == want


def test_sql(spark):
    rows = [r for r in planted(3) if r[0] is not None and (r[1] is None or len(r[1]) == 6)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(negatives.OP13_SQL).fetchall(), key=str) == brute(rows)


def test_bounds_hold():
    """No row of a list scores outside the list's bounds, and lists that can't matter are not visited."""
    rng = np.random.default_rng(5)
    x = rng.integers(-200, 200, (3000, 16))
    c = negatives.kmeans(x.astype(float), 20)
    home, far = negatives.nearest(x.astype(float), c)
    radii = np.array([far[home == j].max(initial=0) for j in range(len(c))])
    lists = negatives.Lists(c, radii, np.bincount(home, minlength=len(c)))
    q = rng.integers(-200, 200, (40, 16))
    low, high = negatives.bounds(q, lists)
    scores = negatives.products(q, x)
    assert (scores >= low[:, home]).all() and (scores <= high[:, home]).all()


def test_products_of_large_numbers():
    q = np.array([[1 << 61, 3], [2, -(1 << 40)]])
    x = np.array([[1, 1], [5, 1 << 40]])
    assert negatives.products(q, x).tolist() == [[(1 << 61) + 3, negatives.HIGH], [2 - (1 << 40), -(1 << 63)]]


def test_empty_and_alone(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, None, 1)]) == []
    assert mined(spark, [(0, [1.0, 2.0], 1), (100, [], 1)]) == []
