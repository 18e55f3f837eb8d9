"""Hot keys: rows without ids, rows repeated very often, one segment value for all codes; and models row by row."""

import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ftrl, hamming, pipeline, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_ring_row_by_row(spark):
    """The ring with bounded loads, a row at a time: arcs in ring order, their overflow after them."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, *range(300)]), rng.choice(["", "a", "b", None, "c" * 9])) for _ in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards, nodes = 7, 16
    got = sharding.assign(df, shards, nodes).collect()
    spots = sharding.ring(spark, shards, nodes, 7)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    keyed = df.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    keyed = keyed.withColumn("pos", F.xxhash64("doc_id", "size", "crc", F.lit(7))).withColumn("cell", F.shiftrightunsigned("pos", 64 - sharding.CELL_BITS)).collect()
    arcs = [[] for _ in spots]
    for r in keyed:
        arcs[next((i for i, (c, _) in enumerate(spots) if c >= r.cell), 0)].append(r)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    used, want = [0] * shards, []
    queue = deque()
    for i, held in enumerate(arcs):
        # the arc that goes round the end of the ring begins, by cells, with those before its node
        held.sort(key=lambda r: (r.cell, r.pos, r.doc_id is not None, r.doc_id or 0, r.size, r.crc))
        queue.append((i, held))
    while queue:
        at, held = queue.popleft()
        if not held:
            continue
        while used[spots[at][1]] >= room[spots[at][1]]:
            at = (at + 1) % len(spots)
        s = spots[at][1]
        k = min(len(held), room[s] - used[s])
        want += [(r.doc_id, r.size, r.crc, s, used[s] + j) for j, r in enumerate(held[:k])]
        used[s] += k
        queue.append(((at + 1) % len(spots), held[k:]))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.size, r.text_crc32, r.shard, r.slot)) for r in got)


def test_rows_without_ids_are_dealt(spark):
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    raw = F.col("text").cast("binary")
    pos = F.xxhash64("doc_id", (F.octet_length(raw) + 16).cast("long"), F.crc32(raw), F.lit(7))
    cells = df.groupBy(F.shiftrightunsigned(pos, 64 - sharding.CELL_BITS)).count()
    assert cells.count() > 10_000
    got = sharding.assign(df).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    assert len(got) == 40 and all(r.n == 500 and r.top == 499 for r in got)


def test_a_row_repeated_often_goes_once(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(5, words, "en", "s", 1)] * 5000 + [(5, words, "en", None, 1), (6, words + " x", "en", "s", 2), (None, words, "en", "s", 1), (7, "other words here", "de", "t", 3)]
    got = pipeline.dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, words, "en", None, 1), (7, "other words here", "de", "t", 3), (None, words, "en", "s", 1)], key=str)


@pytest.mark.parametrize("constant", [True, False])
def test_top_k_with_one_segment_for_all(spark, constant, monkeypatch):
    """A segment that all codes share, and queries that go over to a scan, give what brute force gives."""
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2, (400, 24))
    if constant:
        codes[:, :8] = 1
        codes[7:9] = 1 - codes[7:9]  # far from all others
    rows = [(i, [1.0 if b else -1.0 for b in c]) for i, c in enumerate(codes.tolist())]
    got = {}
    for r in hamming.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 7 == 0, 5, 24).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.vec_id)
    for q in range(0, 400, 7):
        want = sorted((int((codes[q] != codes[i]).sum()), i) for i in range(400) if i != q)[:5]
        assert [got[q][n + 1] for n in range(5)] == want


def test_ftrl_weight_by_weight():
    """The vectorised trainer against the published update of one weight after another."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["good", "fine", "bad", "!!", "zz zz", "word", "x1"], k=rng.randrange(0, 9))) for _ in range(60)]
    labels = np.array([int("good" in t) for t in texts])
    shape = ftrl.Shape(buckets=1 << 10, epochs=2)
    got, bias = ftrl.train(texts, labels, shape)
    rows = []
    for t in texts:
        f = np.concatenate([f for f, _ in ftrl._grams([t], shape)]).tolist()
        rows.append({b: f.count(b) * shape.gain / max(1, len(f)) for b in set(f)})
    z, n = [0.0] * shape.buckets, [0.0] * shape.buckets

    def weight(i):
        if abs(z[i]) <= shape.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * shape.l1) / ((shape.beta + n[i] ** 0.5) / shape.alpha + shape.l2)

    order = np.random.default_rng(shape.seed)
    for _ in range(shape.epochs):
        for i in order.permutation(len(rows)):
            p = 1 / (1 + np.exp(-(sum(weight(b) * x for b, x in rows[i].items()) + shape.empty)))
            was = {b: weight(b) for b in rows[i]}
            for b, x in rows[i].items():
                g = (p - labels[i]) * x
                sigma = ((n[b] + g * g) ** 0.5 - n[b] ** 0.5) / shape.alpha
                z[b] += g - sigma * was[b]
                n[b] += g * g
    want = np.array([weight(i) for i in range(shape.buckets)])
    assert np.abs(want).max() > 0.01 and np.allclose(got, want, atol=2e-3)
    odds = ftrl.log_odds(texts, got, bias, shape)
    assert np.allclose(odds, [sum(got[b] * x for b, x in r.items()) + bias for r in rows], atol=1e-3)


def test_recurrent_forward_pass_token_by_token():
    """The published gate equations and the class-factored softmax, one token after another in plain floats."""
    from palimpsest.llm import gru

    shape = gru.Shape(classes=3, width=4, hidden=5)
    rng = np.random.default_rng(8)
    p = gru.initial(rng.integers(0, 50, shape.words), shape)
    p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in p.items()}
    texts = [rng.integers(0, shape.words, n).tolist() for n in (1, 7, 40, 3, 40)]
    start = 2
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    want = []
    for text in texts:
        h, before, total = [0.0] * 5, start, 0.0
        for word in text:
            u = [sum(h[i] * float(p["h"][i, j]) for i in range(5)) for j in range(15)]
            x = [float(p["x"][before, j]) + float(p["b"][j]) for j in range(15)]
            z, r = ([sigmoid(x[k * 5 + j] + u[k * 5 + j]) for j in range(5)] for k in (0, 1))
            n = [math.tanh(x[10 + j] + r[j] * u[10 + j]) for j in range(5)]
            h = [z[j] * h[j] + (1 - z[j]) * n[j] for j in range(5)]
            c, w = divmod(word, shape.width)
            classes = [sum(h[i] * float(p["cw"][i, k]) for i in range(5)) + float(p["cb"][k]) for k in range(3)]
            words = [sum(h[i] * float(p["ww"][c, i, k]) for i in range(5)) + float(p["wb"][c, k]) for k in range(4)]
            total += classes[c] - math.log(sum(map(math.exp, classes))) + words[w] - math.log(sum(map(math.exp, words)))
            before = word
        want.append(total)
    first = np.cumsum([0, *map(len, texts)])
    got = gru.score(p, np.concatenate(texts), first, start, shape)
    assert np.allclose(got, want, rtol=1e-4)


def test_subword_training_step_by_step():
    """Embeddings and softmax trained jointly, one number after another, and the score as the softmax of the mean bag."""
    from palimpsest.llm import subword

    shape = subword.Shape(buckets=64, dim=3, steps=40)
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["kind", "words", "awful", "trash", "plain"], k=rng.randrange(1, 5))) for _ in range(12)]
    labels = np.array([int("awful" in t or "trash" in t) for t in texts])
    weights, bias = subword.train(texts, labels, shape)
    start = np.random.default_rng(shape.seed)
    emb = start.uniform(-1 / 3, 1 / 3, (64, 3)).astype(np.float32).astype(float).tolist()
    out, g_out = [[-0.5] * 3, [0.5] * 3], [[1e-8] * 3 for _ in range(2)]
    g_emb, base = [1e-8] * 64, [0.0, shape.empty]
    bags = []
    for t in texts:
        f = subword.features([t], shape)[0].tolist()
        bags.append({b: f.count(b) / (shape.calm + len(f)) for b in sorted(set(f))})
    share = np.bincount(labels, minlength=2)[labels] / len(labels)
    for _ in range(-(-shape.steps // len(bags))):
        for i in start.permutation(len(bags)):
            v = [sum(k * emb[b][d] for b, k in bags[i].items()) for d in range(3)]
            z = [sum(out[c][d] * v[d] for d in range(3)) + base[c] for c in (0, 1)]
            p = [math.exp(x - max(z)) for x in z]
            delta = [(x / sum(p) - (labels[i] == c)) * (0.5 / share[i]) ** shape.balance for c, x in enumerate(p)]
            back = [sum(delta[c] * out[c][d] for c in (0, 1)) for d in range(3)]
            for b, k in bags[i].items():
                step = [k * x for x in back]
                g_emb[b] += sum(x * x for x in step) / 3
                emb[b] = [emb[b][d] - shape.rate * step[d] / math.sqrt(g_emb[b]) for d in range(3)]
            for c in (0, 1):
                for d in range(3):
                    g_out[c][d] += (delta[c] * v[d]) ** 2
                    out[c][d] -= shape.rate * delta[c] * v[d] / math.sqrt(g_out[c][d])
    want = [sum(emb[b][d] * (out[1][d] - out[0][d]) for d in range(3)) for b in range(64)]
    assert np.allclose(weights, want, rtol=0.02, atol=0.02 * max(map(abs, want)))
    odds = subword.log_odds(texts, weights, bias, shape)
    assert np.allclose(odds, [sum(k * weights[b] for b, k in bag.items()) + bias for bag in bags], atol=1e-4)


def test_the_pipeline_on_empty_tables(spark, tmp_path):
    kinds = {"documents": DOCS, "labels": "doc_id long, quality int, toxic int"}
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []
