"""The operators of `llm` against brute force, round trips and held-out accuracy, and their defined edge cases."""

import math
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import classify, ftrl, gru, hamming, licenses, lm_scoring, mixing, near_dedup, nnls, packing, sharding, subword, tiff
from palimpsest.llm.components import components
from palimpsest.llm.sketch import sketches
from palimpsest.llm.text import Buffer, shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"
_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return _WORD.findall((text or "").translate(_LOW))


def frame(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 7, 0.5) for d, t, s in rows], DOCS)


def corpus(rng, n=60):
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        rows.append((i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 80))), f"s{i % 3}"))
    for i in range(n, n + 40):  # near copies of a few
        said = rows[i % 4][1].split()
        for _ in range(rng.randrange(4)):
            said[rng.randrange(len(said))] = rng.choice(vocabulary)
        rows.append((i, " ".join(said), "s0"))
    odd = [(200, None, None), (201, "", "s1"), (202, " \t\n", "s1"), (203, "one", "s2"), (204, "One", "s2"), (None, "one", None), (3, rows[3][1], "s0"), (3, rows[3][1], "s0"), (205, "long " * 30000, "s9")]
    return rows + odd


# near-duplicates ------------------------------------------------------------------------------------------------


def brute_components(rows, n, percent=80):
    sets = {}
    for d, t, _ in rows:
        if d is not None:
            w = words(t)
            sets[d] = frozenset(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()
    home = {d: d for d in sets}

    def find(x):
        return x if home[x] == x else find(home[x])

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                home[q] = p
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


@pytest.mark.parametrize("n", [2, 5])
def test_near_dedup(spark, n):
    rows = corpus(random.Random(n))
    want, size = brute_components(rows, n)
    got = near_dedup.near_dedup(frame(spark, rows), ngram=n).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], size[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_dedup_blocks(spark, monkeypatch):
    """A group cut into many blocks links as one that is whole."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        said = list(base)
        for _ in range(rng.randrange(9)):
            said[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(said), "s"))
    want, _ = brute_components(rows, 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 900)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(frame(spark, rows), ngram=2).collect()}
    assert got == want


def test_near_dedup_beyond_the_leader(spark, monkeypatch):
    """Chains, whose ends are like no leader, and families that share buckets without being alike; nothing is broadcast."""
    rng = random.Random(13)
    rows, n = [], 0
    for _ in range(6):
        said = [f"w{rng.randrange(4000)}" for _ in range(60)]
        for _ in range(25):  # each a step from the one before
            said = list(said)
            for _ in range(rng.choice([2, 3, 3, 8])):
                said[rng.randrange(60)] = f"x{rng.randrange(4000)}"
            rows.append((n, " ".join(said), "s"))
            n += 1
    base = [f"y{i}" for i in range(60)]
    for _ in range(60):  # about 0.7 alike
        said = [x if rng.random() < 0.91 else f"z{rng.randrange(4000)}" for x in base]
        rows.append((n, " ".join(said), "s"))
        n += 1
    rng.shuffle(rows)
    want, _ = brute_components(rows, 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(near_dedup, "FEW", 3)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(frame(spark, rows), ngram=2).collect()}
    assert got == want


def test_near_dedup_of_texts_that_share_an_id(spark):
    rng = random.Random(21)
    a, b = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=80)) for _ in range(2))
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(5, a, "s"), (5, b, "s"), (3, near(b), "s"), (7, near(a), "s"), (7, "", "s")]
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in near_dedup.near_dedup(frame(spark, rows), ngram=2).collect())
    assert got == [(3, 3, 79), (5, 3, 79), (5, 5, 79), (7, 5, 79), (7, 7, 0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert near_dedup.near_dedup(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert classify.toxicity(none, none, labels).count() == 0
    assert classify.quality(none, none, labels).count() == 0
    assert tiff.digests(tiff.media_of(none)).count() == 0
    assert packing.pack(none, packing.tokenizer_path()).count() == 0
    assert licenses.license_scan(none).count() == 0
    assert sharding.assign(none).count() == 0
    assert lm_scoring.lm_scores(none, F.lit(True)).count() == 0
    assert hamming.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    for links in ([], [(1, 1)], [(i, i + 1) for i in range(40)], [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]):
        home = {x: x for ab in links for x in ab}

        def find(x, home=home):
            return x if home[x] == x else find(home[x])

        for a, b in links:
            p, q = sorted((find(a), find(b)))
            home[q] = p
        want = {x: find(x) for ab in links for x in ab if any(c != d and x in (c, d) for c, d in links)}
        assert {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_sketches_fill_and_agree():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 2, 50, 1000]
    e = [rng.integers(0, 2**63, n).astype(np.uint64) for n in sizes]
    s = sketches(np.concatenate(e), np.cumsum([0, *sizes]), 200)
    assert (s[0] == 2**64 - 1).all() and (s[1:] != 2**64 - 1).all()
    both = rng.integers(0, 2**63, 800).astype(np.uint64)
    a, b = np.concatenate([both, e[4][:100]]), np.concatenate([both, e[4][100:200]])
    s = sketches(np.concatenate([a, b]), np.array([0, 900, 1800]), 2000)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.04


@given(st.lists(st.text("ab é\n\t\x0b.", max_size=20), max_size=6), st.integers(1, 4))
@settings(max_examples=80)
def test_shingles(texts, n):
    b = Buffer(texts)
    start, end, doc = b.spans()
    _, off = shingle_sets(b.hashes(start, end), doc, len(texts), n)
    for i, t in enumerate(texts):
        w = words(t)
        want = len(set(zip(*(w[j:] for j in range(n)), strict=False))) if len(w) >= n else bool(w)
        assert off[i + 1] - off[i] == want


# mixing ---------------------------------------------------------------------------------------------------------


def test_mix(spark):
    rows = corpus(random.Random(4))
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {s: sum(len(words(t)) for _, t, x in rows if x == s) for s in {r[2] for r in rows}}
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    level, capped = 0.0, set()
    while True:  # one source at a time
        free = [s for s in size if s not in capped]
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level >= 2 * size[s]]
        if not over:
            break
        capped.add(max(over, key=lambda s: weight[s] * level - 2 * size[s]))
    for s in size:
        want = 2 * size[s] if s in capped else weight[s] * level
        mine = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, want, rel_tol=1e-9, abs_tol=1e-9) and r.source_size == size[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want) <= 0.5 + 1e-9
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    key = lambda r: (str(r.doc_id), r.source or "", r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_repeated_rows_of_the_mix(spark):
    rows = corpus(random.Random(4))
    d = frame(spark, rows)
    out = mixing.repeated(d)
    assert out.columns == d.columns and {r["size"] for r in out.collect()} <= {7}
    times = Counter((r.doc_id, r.source) for r in out.collect())
    for r in mixing.mix(d).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("t"), F.count("*").alias("n")).collect():
        # wordless rows come as often as their source is taken whole
        assert abs(times[(r.doc_id, r.source)] * r["size"] - r.t) <= r["size"]


# classifiers ----------------------------------------------------------------------------------------------------


def labelled(spark, n=400):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        said = rng.choices(vocabulary, k=40)
        toxic, bad = i % 4 == 0, i % 5 == 0
        if toxic:
            said[rng.randrange(40)] = rng.choice(["scoundrel", "scoundrels", "scoundrelly", "scouundrel"])
        if bad:
            said = [x + "###" for x in said]
        rows.append((i, " ".join(said), "s"))
        labels.append((i, int(not bad), int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r for r in labels}


@pytest.mark.parametrize(("score", "at", "least"), [(classify.toxicity, 2, 0.5), (classify.quality, 1, 0.3)])
def test_held_out_accuracy(spark, score, at, least):
    docs, labels, known = labelled(spark)
    d = score(docs, docs, labels, out="score")
    assert d.columns.count("score") == 1
    held = [r for r in d.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(0 <= r.score <= 1 for r in held)
    right = sum((r.score >= least) == bool(known[r.doc_id][at]) for r in held)
    assert right / len(held) > 0.9


def test_classifiers_without_labels(spark):
    docs = frame(spark, [(1, None, "s"), (2, "", "s"), (2, "x", "s")])
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert [r.score for r in classify.toxicity(docs, docs, none).collect()] == [0.0] * 3
    assert [r.score for r in classify.quality(docs, docs, none).collect()] == [1.0] * 3


@pytest.mark.parametrize("model", [subword, ftrl])
def test_empty_texts_score_as_the_bias(model):
    w, b = model.train(["good text here", "bad bad ###", "", "fine words"] * 5, np.array([1, 0, 1, 1] * 5), model.Shape())
    z = model.log_odds(["", None, "good text"], w, b, model.Shape())
    assert z[0] == z[1] == b and np.isfinite(z).all()


# media ----------------------------------------------------------------------------------------------------------


@given(st.binary(max_size=3000), st.sampled_from([b"", b"ab", b"aaaa"]))
@settings(max_examples=60)
def test_codecs(data, more):
    data = data + more * 300
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
def test_pages(compression, predictor, tiled):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 4, (h, w), dtype=np.uint8) * 60 for h, w in ((1, 1), (17, 100), (130, 65))]
    got = list(tiff.read(tiff.write(images, compression, predictor, tiled)))
    assert [(p.width, p.height, p.samples) for p in got] == [(i.shape[1], i.shape[0], i.tobytes()) for i in images]


def test_page_rows(spark):
    good = tiff.write([np.zeros((2, 3), np.uint8)] * 2, tiff.LZW, 1, False)
    rows = [(1, good), (2, b"no"), (3, good[:40]), (4, None), (5, b"")]
    got = sorted((r.k, r.page, r.samples, r.error is None) for r in tiff.pages(spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows], "k long, media binary"), "k", "media").collect())
    assert got[0] == (1, 0, bytearray(6), True) and got[1][:2] == (1, 1) and [g[0] for g in got if not g[3]] == [2, 3, 5]


def test_media_digests(spark):
    import hashlib

    rows = corpus(random.Random(1))
    for r in tiff.digests(tiff.media_of(frame(spark, rows))).collect():
        raw = next((t or "").encode() for d, t, _ in rows if d == r.doc_id)
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))


# packing --------------------------------------------------------------------------------------------------------


@given(st.text("ab,. \n\té1²'s\x01\x02　\x1c!日é", max_size=40))
@settings(max_examples=300, deadline=None)
def test_encoder(text):
    e = packing._encoders.setdefault("test", packing.Encoder(packing.tokenizer_path(), 50))
    assert next(e.encode([text])) == array("I", e.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@given(st.lists(st.integers(0, 30), min_size=64, max_size=64))
@settings(max_examples=30, deadline=None)
def test_plan_places_every_document(counts):
    h = np.array([0, *counts[1:]])
    entries, n = nnls.plan(h, 64)
    placed, used = Counter(), {}
    for length, many, first, offset in entries:
        placed[length] += many
        for s in range(first, first + many):
            used.setdefault(s, []).append((offset, length))
    assert all(placed[i] == h[i] for i in range(64)) and len(used) == n
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64


def test_pack(spark):
    rows = corpus(random.Random(2))
    got = packing.pack(frame(spark, rows), packing.tokenizer_path()).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for d, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        at, stop, piece = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            want[(d, piece, at, stop - at, zlib.crc32(array("I", ids[at:stop]).tobytes()))] += 1
            at, stop, piece = stop, stop + 1024, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = 0
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total += 1
    assert total <= -(-sum(r.length for r in got) // 1024) + 1


# licences -------------------------------------------------------------------------------------------------------


def test_expressions():
    assert licenses.evaluate("(MIT OR GPL-3.0-only) AND Apache-2.0") == ({"mit", "gpl", "apache-2.0"}, 0.9)
    assert licenses.evaluate("GPL-2.0-or-later WITH Classpath-exception-2.0") == ({"gpl"}, 0.7)
    assert licenses.evaluate("MIT AND GPL-2.0 OR CC0-1.0")[1] == 1.0
    for broken in ("MIT OR", "(MIT", "AND MIT", "MIT)", ""):
        assert licenses.evaluate(broken)[1] is None


def test_scan(spark):
    rows = [
        (1, "CC-BY x cc by. All rights reserved, GENERAL public\nlicense", "s"), (2, None, "s"), (3, "SPDX-License-Identifier: MIT OR GPL-2.0\ncode", "s"), (4, "accby cc  byé", "s"),
        (None, "cc by cc by", "s"), (5, "x " * 50000 + "all rights reserved", "s"),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert tuple(got[1])[1:6] == (11, 4, 0, 8, "cc-by,gpl,reserved") and got[1].score == 0.0
    assert tuple(got[2])[1:] == (0, 0, None, None, "", "", 0.5)
    assert got[3].labels == "gpl,mit" and got[3].base_labels == "" and got[3].score == 0.95
    assert got[4].n_base == 0 and got[None].n_base == 2 and got[None].last_word == 2
    assert got[5].first_word == 50000


# top-k ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [3, 10])
def test_top_k(spark, k):
    rng = random.Random(k)
    base = [rng.choice([-1.0, 1.0]) for _ in range(16)]
    rows = [(i, [x * (1 if rng.random() > 0.2 else -1) for x in base]) for i in range(90)]
    rows += [(i, list(base)) for i in range(100, 130)] + [(7, rows[7][1]), (300, None), (301, [1.0]), (None, list(base)), (302, [None] * 16)]
    got = hamming.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0, k, 16).collect()
    codes = {i: tuple((x or 0) > 0 for x in v) for i, v in rows if i is not None and v is not None and len(v) == 16}
    want = set()
    for q in codes:
        if q % 10 == 0:
            near = sorted((sum(a != b for a, b in zip(codes[q], codes[i], strict=True)), i) for i in codes if i != q)[:k]
            want |= {(q, r, i, d) for r, (d, i) in enumerate(near, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_of_few(spark):
    rows = [(0, [1.0] * 16), (10, [-1.0] * 16)]
    got = hamming.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.lit(True), 10, 16).collect()
    assert {tuple(r) for r in got} == {(0, 1, 10, 16), (10, 1, 0, 16)}


# sharding -------------------------------------------------------------------------------------------------------


def test_shards(spark):
    rows = corpus(random.Random(9)) + [(999, "same", "s")] * 50
    got = sharding.assign(frame(spark, rows), shards=7, nodes=16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    counts = Counter(r.shard for r in got)
    assert len(counts) == 7 and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def test_few_rows_move_with_loose_loads(spark):
    rows = frame(spark, [(i, f"text {i}", "s") for i in range(600)])
    a = {r.doc_id: r.shard for r in sharding.assign(rows, shards=8, load=1.5).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign(rows, shards=9, load=1.5).collect()}
    assert max(Counter(a.values()).values()) <= math.ceil(1.5 * 600 / 8)
    assert sum(a[i] != b[i] for i in a) < 600 * 0.35


def test_overflow_goes_on_clockwise():
    plan = sharding.overflow_plan([5, 0, 1, 0], [0, 1, 2, 1], [2, 2, 2])
    assert plan == [(0, 0, 2, 0, 0), (2, 0, 1, 2, 0), (0, 2, 4, 1, 0), (0, 4, 5, 2, 1)]
    with pytest.raises(ValueError):
        sharding.overflow_plan([5], [0], [2])


# language model -------------------------------------------------------------------------------------------------


def test_gradients():
    sh = gru.Shape(classes=3, width=4, hidden=5, window=6, batch=3)
    rng = np.random.default_rng(0)
    p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in gru.initial(rng.integers(1, 50, 12), sh).items()}
    inputs, targets, h0 = rng.integers(0, 12, (6, 3)), rng.integers(0, 12, (6, 3)), rng.normal(0, 1, (3, 5))
    real, goes_on = np.ones((6, 3), bool), np.ones((6, 3))
    real[4:, 1] = False
    goes_on[3, 2] = goes_on[2, 0] = goes_on[2, 1] = 0

    def loss():
        h, total = h0, 0.0
        for t in range(6):
            h = gru._step(p["x"][inputs[t]] + p["b"], h * goes_on[t][:, None], p["h"], 5)[0]
            total -= (gru._word_log_p(p, h, targets[t], sh) * real[t]).sum()
        return total / real.sum()

    g, rows, _ = gru._window(p, inputs, targets, real, goes_on, h0, sh)
    g["x"] = _spread(g["x"], rows, p["x"])
    for k in p:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in p[k].shape)
            keep = p[k][at]
            p[k][at] = keep + 1e-4
            up = loss()
            p[k][at] = keep - 1e-4
            down = loss()
            p[k][at] = keep
            assert abs((up - down) / 2e-4 - g[k][at]) < 1e-3


def _spread(part, rows, like):
    out = np.zeros_like(like)
    out[rows] = part
    return out


def test_probabilities_sum_to_one_and_state_is_carried():
    sh = gru.Shape(classes=3, width=4, hidden=5)
    p = gru.initial(np.arange(12), sh)
    p["cw"] = np.random.default_rng(1).normal(0, 1, p["cw"].shape).astype(np.float32)
    total = sum(np.exp(gru.score(p, np.array([a, b]), np.array([0, 2]), 1, sh)[0]) for a in range(12) for b in range(12))
    assert abs(total - 1) < 1e-4
    text = np.random.default_rng(2).integers(0, 12, 500)
    short, long = gru.Shape(classes=3, width=4, hidden=5, window=3), gru.Shape(classes=3, width=4, hidden=5, window=1000)
    first = np.array([0, 500, 503])
    both = np.concatenate([text, text[:3]])
    assert np.allclose(gru.score(p, both, first, 1, short), gru.score(p, both, first, 1, long), atol=1e-3)


def test_lm_scores(spark):
    rows = corpus(random.Random(3))
    learn = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True))
    plan = lm_scoring.Plan(heavy=50, shape=gru.Shape(classes=4, width=4))
    got = lm_scoring.lm_scores(frame(spark, rows), learn, plan).collect()
    c = Counter()
    for d, t, _ in rows:
        if d is None or d % 3 != 1:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        for d, t, _ in rows:
            if d == r.doc_id:
                said = [*words(t), None]
                assert (r.n_tokens, r.n_known, r.train_tokens) == (len(said), sum(c[w] > 0 for w in said), n)
                assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in said), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
