"""Components of few links cost few tasks whatever the shuffle partitions; near-dedup hands on links between homes only."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import components as c
from palimpsest.llm import near_dedup

LINKS = "a long, b long"


@pytest.fixture
def dealt_wide(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def brute(links):
    least = {x: x for ab in links for x in ab}
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def tasks_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))


def chains(rng):
    links = [(i, i + 1) for i in range(0, 600) if i % 60 != 59] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    return [x for x in links if x[0] != x[1]]


def test_few_links_take_few_tasks(spark, dealt_wide):
    links = chains(random.Random(4))
    got, tasks = tasks_of(spark, "few links", lambda: {r.node: r.component for r in c.components(spark.createDataFrame(links, LINKS)).collect()})
    assert got == brute(links)
    assert tasks < 2500


def test_many_links_and_few_agree(spark, monkeypatch):
    """The first rounds shuffled, the last ones broadcast."""
    links = chains(random.Random(6))
    for few in (0, 40):
        monkeypatch.setattr(c, "FEW", few)
        assert {r.node: r.component for r in c.components(spark.createDataFrame(links, LINKS)).collect()} == brute(links)


def test_links_between_homes_only(spark, monkeypatch):
    """Families of copies that their leaders explain leave little to contract; their members have one component all the same."""
    rng, seen = random.Random(9), []
    rows = []
    for f in range(5):
        said = [f"w{rng.randrange(4000)}" for _ in range(80)]
        for i in range(30):
            own = list(said)
            own[i] = f"x{f}"
            rows.append((100 * f + i, " ".join(own)))

    def watched(links):
        seen.append(links.where(F.col("a") != F.col("b")).count())
        return c.components(links)

    monkeypatch.setattr(near_dedup, "components", watched)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), ngram=2).collect()
    assert all(r.component_id == r.doc_id // 100 * 100 for r in got) and len({r.component for r in got}) == 5
    assert seen[0] < 300  # 161 when written; 515 with links between members
