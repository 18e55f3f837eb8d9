"""Expansion to all links: users are searched as they pass by, those of very many links in rounds."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import retrieve


def memory(spark):
    """A chain of 40 links with a cycle and a shortcut, a revoked item in another, links that lead nowhere, a user without seeds and one without a name."""
    rows = [("a", i, i - 1 if i > 1 else None, [40] if i == 1 else [5, 99] if i == 20 else None, "active") for i in range(1, 42)]
    rows += [("b", i, i - 1 if i > 1 else None, None, "revoked" if i == 3 else "active") for i in range(1, 7)]
    rows += [("c", i, i - 1, None, "active") for i in range(1, 4)] + [(None, i, i - 1, None, "active") for i in range(1, 4)]
    return spark.createDataFrame([(u, i, s, None, r, t) for u, i, s, r, t in rows], "user_id string, id long, supersedes_id long, contradicts_ids array<long>, related_ids array<long>, status string")


WANT = [("a", i) for i in range(1, 40)] + [("b", 4), ("b", 5)]


@pytest.mark.parametrize("most", [1 << 16, 45, 3])
def test_what_links_reach(spark, monkeypatch, most):
    monkeypatch.setattr(retrieve, "SEARCHED", most)
    m = memory(spark)
    seeds = m.where("(user_id = 'a' and id = 40) or (user_id = 'b' and id = 6) or (user_id is null and id = 3)")
    got = retrieve.expand_all(seeds, m, active_only=False)
    assert sorted((r.user_id, r.id) for r in got.collect()) == WANT


def test_a_long_chain_takes_no_round_a_link(spark, monkeypatch):
    rounds = []
    plain = retrieve.stored
    monkeypatch.setattr(retrieve, "stored", lambda df: rounds.append(1) or plain(df))
    m = memory(spark)
    assert retrieve.expand_all(m.where("user_id = 'a' and id = 40"), m).where(F.col("user_id") == "a").count() == 39
    assert len(rounds) < 5
