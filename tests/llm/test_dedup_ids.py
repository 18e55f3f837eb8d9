"""The pipeline's near-dedup where different texts share an id."""

import random

import corpus_pipeline as cp


def test_texts_that_share_an_id(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=80)) for _ in range(3))
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(5, a), (5, b), (5, b), (7, near(a)), (3, near(b)), (9, c), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.dedup(spark, docs, "")
    assert got.columns == cp.COLUMNS
    # b goes with its copy of a smaller id, a stays though it has b's id, and takes its own copy out
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(5, a), (3, near(b)), (9, c), (9, "")])
