"""Connected components of links, by contraction; nothing is gathered on the driver or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.base import cut


#: Links that a few tasks take on, their moves broadcast (at most twice as many rows of two numbers); more are shuffled.
FEW, TASKS = 1 << 15, 8


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that `links` (a, b: two longs) names; component is its smallest node.

    In each round every node moves to the neighbour (or itself) with the smallest hash, under a new hash each
    round, and links between moved nodes go on; the number of nodes falls by a constant factor a round. Repeated
    links, links to itself and an empty frame are all right.
    """
    ordered = lambda e: e.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(ordered(links))
    homes = None
    turn = 0
    while n := edges.count():
        turn += 1
        # else each round would cost the driver a task for every shuffle partition, several times
        dealt, sent = (lambda df: df.coalesce(TASKS), F.broadcast) if n <= FEW else (lambda df: df, lambda df: df)
        edges = dealt(edges)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)), F.col(c).alias("node"))  # noqa: B023, E731
        moves = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        moves = cut(dealt(moves.select(F.col("a").alias("was"), F.least("best", rank("a"))["node"].alias("now"))))
        if homes is None:
            homes = moves.select(F.col("was").alias("node"), F.col("now").alias("home"))
        else:
            homes = cut(homes.join(sent(moves), homes["home"] == moves["was"], "left").select("node", F.coalesce("now", "home").alias("home")))
        edges = edges.join(sent(moves), edges["a"] == moves["was"]).select(F.col("now").alias("a"), "b")
        edges = edges.join(sent(moves), edges["b"] == moves["was"]).select("a", F.col("now").alias("b"))
        edges = cut(dealt(ordered(edges)))
    if homes is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    least = homes.groupBy("home").agg(F.min("node").alias("component"))
    return homes.join(least, "home").select("node", "component")
