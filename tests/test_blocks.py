"""Texts that have most grams in common are compared in blocks, each pair once, with the same pairs as all pairs give."""

import random

import pytest

from palimpsest.functions import qgrams
from palimpsest.functions.scoring import similarity_of

WORDS = "neon turso postgres redis kafka".split()


def test_rows_of_words_of_64_bits():
    rng = random.Random(4)
    text = lambda: "".join(rng.choices("abcdé ", k=rng.choice([1, 5, 40, 63, 64, 65, 128, 150]))).strip() or "x"
    left = [text() for _ in range(60)]
    left += ["".join(ch for ch in x if rng.random() < 0.9).strip() or "y" for x in left]
    for least in (0.4, 0.75, 0.9):
        got = {(int(i), j): s for ids, j, sims in qgrams.block_pairs(left, left[::-1], least) for i, s in zip(ids, sims, strict=True)}
        want = {(i, j): similarity_of(a, b) for i, a in enumerate(left) for j, b in enumerate(left[::-1]) if similarity_of(a, b) >= least}
        assert {k: v for k, v in got.items()} == want


@pytest.mark.parametrize("block", [1024, 7])
def test_like_texts_meet_once(spark, monkeypatch, block):
    monkeypatch.setattr(qgrams, "BLOCK", block)
    compared = []
    monkeypatch.setattr(qgrams, "verified", lambda *a: compared.append(a))  # the index finds nothing to compare in such groups
    rows = [(i, u, f"the plan is to move {w} number {i} to another region", w) for i, (u, w) in enumerate((u, w) for u in "uv" for w in WORDS for _ in range(6))]
    f = spark.createDataFrame(rows, "id long, user_id string, norm string, home string")
    close = lambda a, b: a[1] == b[1] and similarity_of(a[2], b[2]) >= 0.75
    got = qgrams.similar_texts(f.drop("home"), ["user_id"], 0.75).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and close(a, b))
    got = qgrams.similar_texts(f, ["user_id"], 0.75).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[3] != b[3] and close(a, b))
    got = qgrams.similar_texts(f.where("id % 2 = 0").drop("home"), ["user_id"], 0.75, f.drop("home")).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] % 2 == 0 and close(a, b))
