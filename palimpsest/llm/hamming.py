"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each component, set where the component is positive. Codes are cut into m segments of
at most log2(rows) bits, so that a segment value has a code or a few: a code too many costs a comparison inside the
join, while a bit more in a segment would multiply the values to look up. Step t looks up, in segment t mod m, all values
at distance t div m from the query's: after it, every code within distance t of the query has been found, as one
farther off in every segment than has been looked up differs in more than t bits. A query is done when the distance
of its k-th best neighbour is at most t, so nothing that could tie or beat it is missing. A candidate is verified
(its full distance must not be above the present k-th, and no earlier step may have found it) inside the join, so
only neighbours that matter leave it. How far a k-th neighbour can be is known from the start, from a few hundred codes. A query
that would look up more values than there are codes meets every code once instead, in blocks.

Defined results: rows with a null id, a null vector or a vector of another length than `bits` take no part; a null
component counts as not positive. Repeated rows count once; a vector is no neighbour of itself, but one with an equal
code is. Ties are ordered by id. With fewer than k other rows all are returned. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, comb, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.base import cut, table


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, bits: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest of all rows of `vectors` (vec_id, embedding) for each query."""
    text = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    rows = cut(vectors.where((F.size("embedding") == bits) & F.col("vec_id").isNotNull()).select("vec_id", text.alias("bits")).distinct())
    n = rows.count()
    m = max(1, min(bits, ceil(bits / max(1.0, log2(max(2, n))))))
    edges = [bits * j // m for j in range(m + 1)]
    widths = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    segments = F.array(*[F.conv(F.substring("bits", a + 1, w), 2, 10).cast("long") for a, w in zip(edges, widths, strict=False)])
    rows = rows.select("vec_id", "bits", segments.alias("seg"))
    # of a code's rows only the k + 1 smallest ids can be neighbours
    first = F.row_number().over(Window.partitionBy("bits").orderBy("vec_id"))
    codes = cut(rows.withColumn("__n", first).where(F.col("__n") <= k + 1).select("vec_id", "seg"))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("seg").alias("own"), F.lit(bits).alias("reach"))
    active = cut(_first_reach(queries, codes, m, k))
    none = active.select("query_id", F.col("query_id").alias("vec_id"), F.lit(0).alias("distance")).limit(0)
    best = none
    t = spent = 0
    while t <= bits + m and not active.isEmpty():
        j, r = t % m, t // m
        spent += comb(widths[j], r)
        if spent > n:  # looking up more values than there are codes: the rest of the queries meet every code once
            return _ranked(best.join(active.select("query_id"), "query_id", "left_anti").unionByName(_scanned(active, codes, m, n)), k)
        if r <= widths[j]:
            index = codes.select(F.col("seg")[j].alias("value"), "vec_id", "seg")
            new = (_whole(m) <= F.col("reach")) & (F.col("query_id") != F.col("vec_id"))
            for i in range(m):
                if i != j and (i < j or r):
                    new = new & (_distance(F.col("own")[i], F.col("seg")[i]) > (r if i < j else r - 1))
            probes = _probes(active, j, widths[j], r)
            found = probes.join(index, (probes["value"] == index["value"]) & new).select("query_id", "vec_id", _whole(m).alias("distance"))
            best = cut(_ranked(best.unionByName(found), k).drop("rank"))
            reach = best.groupBy("query_id").agg(F.count("*").alias("have"), F.max("distance").alias("far"))
            state = active.join(reach, "query_id", "left")
            nearer = F.when(F.col("have") >= k, F.least("reach", "far")).otherwise(F.col("reach"))
            active = cut(state.withColumn("reach", nearer).where((F.col("reach") > t) & F.lit(t < bits)).select("query_id", "own", "reach"))
        t += 1
    return _ranked(best, k)


def _whole(m: int) -> Column:
    return reduce(lambda a, b: a + b, [_distance(F.col("own")[i], F.col("seg")[i]) for i in range(m)]).cast("int")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def _first_reach(queries: DataFrame, codes: DataFrame, m: int, k: int, most: int = 512) -> DataFrame:
    """`queries` with a `reach` that their k-th distance can't exceed: the k-th among at most `most` codes, picked by a hash."""
    few = F.broadcast(codes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most))  # at most `most` rows
    near = queries.join(few, F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", _whole(m).alias("distance"))
    far = _ranked(near, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("far"))
    return queries.join(far, "query_id", "left").select("query_id", "own", F.coalesce("far", "reach").alias("reach"))


def _probes(active: DataFrame, j: int, width: int, r: int) -> DataFrame:
    """The values at distance r from each query's segment j: its bits are flipped one after another, in rising order."""
    out = active.select("query_id", "own", "reach", F.col("own")[j].alias("value"), F.lit(-1).alias("bit"))
    for step in range(r):
        out = out.withColumn("bit", F.explode(F.sequence(F.col("bit") + 1, F.lit(width - r + step))))
        out = out.withColumn("value", F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))))
    return out.drop("bit")


def _scanned(active: DataFrame, codes: DataFrame, m: int, n: int, block: int = 4096) -> DataFrame:
    """All codes within reach of each query, by blocks of codes; what a query has found before is found again."""
    blocks = -(-n // block)
    dealt = codes.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = active.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = (_whole(m) <= F.col("reach")) & (F.col("query_id") != F.col("vec_id"))
    return asked.join(dealt, (asked["block"] == dealt["block"]) & near).select("query_id", "vec_id", _whole(m).alias("distance"))


def op8_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: The same, by brute force.
OP8_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS code
           FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
d AS (SELECT q.vec_id AS query_id, v.vec_id,
             list_sum(list_transform(list_zip(q.code, v.code), lambda p: CASE WHEN p[1] = p[2] THEN 0 ELSE 1 END))::INTEGER AS distance
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
