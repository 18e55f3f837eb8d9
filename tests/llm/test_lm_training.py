"""LM scoring learns from every learning document, whatever files they lie in."""

import random

import numpy as np
from palimpsest.llm import gru, lm_scoring
from pyspark.sql import functions as F

PLAN = lm_scoring.Plan(heavy=50, shape=gru.Shape(classes=4, width=4))


def test_every_document_trains(spark):
    for i in range(4):
        learning = spark.createDataFrame([(i, "a b a b c")], "doc_id long, text string")
        words, weight, total, _ = lm_scoring.vocabulary(lm_scoring.token_counts(learning), PLAN)
        start = gru.initial(weight, PLAN.shape)
        assert not np.array_equal(lm_scoring.trained(learning, start, words, PLAN, total)["wb"], start["wb"]), i


def test_scores_do_not_follow_the_files(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r.doc_id: r.score for r in lm_scoring.lm_scores(docs.repartition(n), F.lit(True), PLAN).collect()} for n in (1, 12)]
    assert all(abs(got[0][i] - got[1][i]) < 1e-3 * abs(got[0][i]) for i in range(60))


def test_scores_are_those_of_whole_texts(spark):
    """Each text by itself, token by token: the model's word, or the unknown and the token's share of all such tokens."""
    rng = random.Random(8)
    kinds = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(kinds, weights=[1 / (k + 1) for k in range(300)], k=rng.randrange(0, 60)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.col("doc_id") % 4 != 0
    plan = lm_scoring.Plan(heavy=40, share=1000, shape=gru.Shape(classes=4, width=4))
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(docs, learn, plan).collect()}
    counts = lm_scoring.token_counts(docs.where(learn))
    words, weight, total, distinct = lm_scoring.vocabulary(counts, plan)
    assert 14 < len(words.tokens) <= 60
    model = lm_scoring.trained(docs.where(learn), gru.initial(weight, plan.shape), words, plan, total)
    seen = {r.token: r.n for r in counts.collect()}
    kept = set(words.tokens[words.number != words.unknown].view(np.int64).tolist())
    rest = sum(n for t, n in seen.items() if t not in kept)
    share = rest + 0.5 * (max(0, distinct - len(kept)) + 1)
    for i, text in rows:
        [(_, _, t, off)] = list(lm_scoring._tokens([text]))
        n = words.numbers(t)
        want = gru.score(model, n, off, words.end, plan.shape)[0] / np.log(10)
        want += sum(np.log10((seen.get(int(x), 0) + 0.5) / share) for x, k in zip(t.view(np.int64), n, strict=True) if k == words.unknown)
        assert abs(got[i] - want) < 1e-6 * abs(want) + 1e-4, i


def test_as_many_heavy_tokens_however_many_are_equally_frequent(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{i}_{k}" for k in range(400))) for i in range(10)], "doc_id long, text string")
    words, _, total, distinct = lm_scoring.vocabulary(lm_scoring.token_counts(docs), lm_scoring.Plan(heavy=1000, shape=gru.Shape(classes=4, width=4)))
    assert (total, distinct) == (4010, 4001) and 800 < len(words.tokens) < 1200 and int(words.end) != words.unknown
