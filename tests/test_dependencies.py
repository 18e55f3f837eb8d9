"""The fold by components against the fold by users, and the similarity join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import qgrams
from palimpsest.functions.scoring import similarity_of
from palimpsest.operators import dependencies, fold
from palimpsest.sources.schemas import ITEM, names

READY = (
    "user_id string, seq long, content string, type string, topic_key string, authority string, is_correction boolean, subject string, predicate string, value string, scope string, "
    "confidence double, importance double, stability double, freshness double, source_message_ids array<string>, old_value string, new_value string, revoked_target string, revoked_value string, "
    "as_of timestamp, valid_from timestamp, valid_until timestamp"
)
WORDS = "neon turso postgres redis kafka hono astro bun deno rust mocha latte tea river stone cloud ember quartz violet maple".split()


def said(rng):
    return rng.choice(["Database", "Editor", "Runtime", "the plan", "a note"]) + ": " + " ".join(rng.choices(WORDS, k=rng.randrange(1, 5)))


def close(rng, text):
    text = list(text)
    for _ in range(rng.randrange(3)):
        at = rng.randrange(len(text))
        text[at] = rng.choice(["", "x", text[at].upper(), text[at] + "s"])
    return "".join(text) or "x"


def candidates(rng, users, n):
    rows = []
    for u in users:
        known = []
        for seq in range(1, n + 1):
            text = close(rng, rng.choice(known)) if known and rng.random() < 0.4 else said(rng)
            known.append(text)
            kind = rng.choice(["fact", "decision", "preference"])
            old = new = target = None
            value, fixes = "", rng.random() < 0.1
            roll = rng.random()
            if roll < 0.08:
                old, new = rng.choice([rng.choice(WORDS), close(rng, rng.choice(known)), "", "zz", "e"]), "new"
            elif roll < 0.14:
                target, value = rng.choice(["the editor", "plan", "nothing known", rng.choice(WORDS)]), rng.choice(["", rng.choice(WORDS), " Neon "])
            topic = rng.choice([None, "", *[f"{kind}:{x}" for x in "abcdefgh"]]) if rng.random() < 0.7 else f"t{seq}"
            rows.append((u, seq, text, kind, topic, rng.choice(["user", "user", "assistant", "speculation"]), fixes, "s", "p", text.split()[-1], "project", rng.choice([0.5, 0.88, 0.95]), 0.7, 0.5, 1.0, [f"m{seq}"], old, new, target, value, None, None, None))
    return rows


def items(rng, users):
    rows = []
    for u in users:
        for i in rng.sample(range(1, 90), 12):
            rows.append({"id": i, "user_id": u, "content": said(rng), "type": rng.choice(["fact", "decision", "preference"]), "topic_key": rng.choice([None, " fact:a ", "decision:b"]), "confidence": 0.9, "importance": 0.6, "stability": 0.5, "freshness": 1.0, "information_gain": rng.choice([None, 0.8]), "source_message_ids": ["old"], "contradicts_ids": [], "related_ids": [3], "status": rng.choice(["active", "active", "superseded", "revoked"]), "version": 1})
    return [tuple(r.get(n) for n in names(ITEM)) for r in rows]


def rows_of(frame):
    return sorted((tuple(map(str, r)) for r in frame.select(*names(fold.ROW)).collect()), key=str)


@pytest.mark.parametrize(("seed", "start"), [(1, False), (3, True)])
def test_equals_the_fold_by_users(spark, seed, start):
    rng = random.Random(seed)
    users = ["a", "b", None] if seed == 3 else ["a", "b"]
    ready = spark.createDataFrame(candidates(rng, users, 120), READY)
    old = spark.createDataFrame(items(rng, ["a", "c"]), ITEM) if start else None
    want, got = rows_of(fold.fold(ready, old)), rows_of(dependencies.fold_apart(ready, old))
    assert {r[2] for r in want} >= {"create", "supersede", "merge", "reject", "revoke", "skip"}
    assert got == want


def test_one_user_is_many_groups(spark, monkeypatch):
    """A user of 5000 candidates whose topics don't meet: components stay small; ranges and blocks are crossed."""
    monkeypatch.setattr(dependencies, "RANGE_BITS", 8)
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(5, 10)))
    rows = [("hot", i, f"{word()} {word()} {word()}", "fact", f"topic {i % 1500}", "user", False, "s", "p", "v", "project", 0.9, 0.7, 0.5, 1.0, ["m"], None, None, None, "", None, None, None) for i in range(1, 5001)]
    ready = spark.createDataFrame(rows, READY)
    told, _ = dependencies.dealt(ready, spark.createDataFrame([], ITEM))
    sizes = [r.n for r in told.groupBy("component").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1200 and max(sizes) < 40
    done = dependencies.fold_apart(ready).where("kind = 'action'").groupBy("action").count().collect()
    assert {r.action: r["count"] for r in done} == {"create": 1500, "supersede": 3500}


def test_numbered(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.randrange(5)) for i in range(500)]
    rng.shuffle(rows)
    got = dependencies.numbered(spark.createDataFrame(rows, "user_id string, ordinal int, part int").repartition(7), ["ordinal", "part"]).collect()
    for u in ("a", "b", None):
        own = sorted((r for r in got if r.user_id == u), key=lambda r: r.ordinal)
        assert [r.seq for r in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("least", [0.9, 0.75, 0.4])
def test_similar_texts_against_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    texts = list({close(rng, said(rng)).lower().strip() for _ in range(60)} | {"a", "ab", "abc", "abcd", "abce", "xabcd", "", "é", "ée"})
    texts += [t for t in {close(rng, rng.choice(texts) or "q").lower().strip() for _ in range(60)} if t not in texts]
    rows = [(i, rng.choice("uv"), t) for i, t in enumerate(texts)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] and b[2] and similarity_of(a[2], b[2]) >= least}
    f = spark.createDataFrame(rows, "id long, user_id string, norm string")
    got = qgrams.similar_texts(f, ["user_id"], least).collect()
    assert {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want)
    assert all(abs(r.similarity - similarity_of(texts[r.id_a], texts[r.id_b])) < 1e-12 for r in got)
    both = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] and b[2] and similarity_of(a[2], b[2]) >= least}
    assert {(r.id_a, r.id_b) for r in qgrams.similar_texts(f, ["user_id"], least, f).collect()} == both


def test_bounds_exclude_only_what_is_not_alike(monkeypatch):
    """No pair below the bound is compared, and none that is alike lies below it."""
    rng = random.Random(9)
    compared = []
    plain = qgrams.lcs_length
    monkeypatch.setattr(qgrams, "lcs_length", lambda a, b: compared.append((a, b)) or plain(a, b))
    for _ in range(3000):
        a = said(rng).lower()
        b = close(rng, a).lower().strip() if rng.random() < 0.5 else said(rng).lower()
        for least in (0.9, 0.75):
            compared.clear()
            q = qgrams.gram_size(least)
            got = qgrams.verified(a, b, least, q)
            shared = sum((qgrams.grams(a, q) & qgrams.grams(b, q)).values())
            assert bool(compared) == (qgrams.may_match(len(a), len(b), least) and shared >= qgrams.common_grams(len(a), len(b), least, q) - 1e-9)
            assert (got is not None) == (similarity_of(a, b) >= least)
