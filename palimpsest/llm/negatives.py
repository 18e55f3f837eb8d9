"""Hard negatives by exact search in k-means inverted lists.

Centroids are fitted on a bounded sample; every row goes into the list of its nearest centroid, and each list keeps its
radius, the largest distance of a row from the centroid. For a query q, a list of centroid c and radius r holds only
scores between q.c - |q| r and q.c + |q| r (Cauchy-Schwarz). A query visits the lists in the descending order of the
upper bound, skips those that lie outside all its windows of scores, and stops where the bound falls strictly below
its k-th score; ties of the k-th are therefore all seen. The lists to visit are taken in growing steps, so that few
rounds are needed, and what bounds can't exclude is scored in blocks: a list is cut into blocks of about BLOCK rows, the
queries that visit it follow each block as a stream. Results are exact; the bounds only decide what is not looked at.

Both searches are this one: positives are the best rows of the anchor's own label, negatives the best rows of other
labels in a window for each positive, all windows of an anchor being scored together.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part. Rows repeated with
the same id, label and vector count once; rows that share an id but differ are rows of their own, and none is another's
positive. A null id is ordered last, and is no anchor. Shorter vectors count as ended by zeros. Scores are exact;
components and scores beyond 64 bits stop at the ends of that range. Ties of a score go by id, then by label. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.base import cut, table

#: Rows of a block, about: what a task holds of a list at once.
BLOCK = 16384
#: Lists a query visits in its first round; each round goes on to STEP times as many.
FIRST, STEP = 4, 8
#: At most this many lists, and sampled rows for each in fitting.
MOST_LISTS, SAMPLED = 4096, 64

LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Lists:
    """Centroids, radii and numbers of rows of the inverted lists."""

    centroids: np.ndarray
    radii: np.ndarray
    held: np.ndarray


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` integers from an Arrow column of lists, shorter ones ended by zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in floats where all sums stay below 2^53, else in whole numbers without a bound."""
    top = lambda a: max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))
    if top(q) * top(x) * max(1, q.shape[1]) < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    whole = q.astype(object) @ x.astype(object).T
    return np.clip(whole, LOW, HIGH).astype(np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of the rows of x (at most k of them), by Lloyd's rounds from a seeded start."""
    start = np.unique(x[np.random.default_rng(seed).permutation(len(x))[:k]], axis=0)
    c = start.astype(np.float64)
    for _ in range(rounds):
        home = nearest(x, c)[0]
        order = np.argsort(home, kind="stable")
        own, first, n = np.unique(home[order], return_index=True, return_counts=True)
        c[own] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, piece: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the distance from it."""
    size = (c * c).sum(1)
    home = np.concatenate([(size - 2 * (x[i : i + piece] @ c.T)).argmin(1) for i in range(0, len(x), piece)] or [np.zeros(0, np.int64)])
    return home, np.sqrt(((x - c[home]) ** 2).sum(1))


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, each once, their components as integers."""
    x = F.col("embedding")
    good = F.forall(x, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col("label").isNotNull() & x.isNotNull() & good)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda e: F.floor(256 * e.cast("double")).cast("long")).alias("v")).distinct()


def fitted(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Centroids for about sqrt(n) / 4 lists, at most MOST_LISTS, from at most SAMPLED rows a list, picked by a hash."""
    k = max(1, min(MOST_LISTS, math.isqrt(n) // 4))
    most = SAMPLED * k
    share = min(1.0, 2 * most / max(1, n))
    place = F.xxhash64("vec_id", "v")
    near = rows if share == 1.0 else rows.where(place < F.lit(int((share - 0.5) * 2**64)))
    sample = near.orderBy(place, "vec_id", "label").limit(most).select("v")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [matrix(b.column(0), width) for b in batches]
        x = np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, width))
        c = kmeans(x, k) if len(x) else np.zeros((1, width))
        yield pa.RecordBatch.from_arrays([pa.array(c.tolist(), pa.list_(pa.float64()))], names=["c"])

    found = sample.repartition(1).mapInArrow(fit, "c array<double>").collect()  # at most MOST_LISTS rows
    return np.array([r.c for r in found] or [[0.0] * width], np.float64).reshape(-1, width)


def listed(rows: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """`rows` with the list each is in and its distance from the centroid."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_LISTS rows
    at = rows.columns.index("v")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, far = nearest(matrix(b.column(at), width).astype(np.float64), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), pa.array(far, pa.float64())], names=[*b.schema.names, "list", "far"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(assign, f"{kinds}, list int, far double")


def bounds(q: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each list can hold for each query, widened by more than floats can be off."""
    q = q.astype(np.float64)
    mid = q @ lists.centroids.T
    size = np.sqrt((q * q).sum(1))[:, None]
    reach = size * lists.radii
    slack = 1 + 1e-9 * (size * np.sqrt((lists.centroids**2).sum(1)) + reach)
    return mid - reach - slack, mid + reach + slack


def visits(queries: DataFrame, lists: Lists, width: int, first: int, end: int) -> DataFrame:
    """(list, key, own, label, v, low, high): the lists from `first` up to `end` of each query's order that can still matter.

    `queries`: key, own, label, v, and by window `low`, `high` and `kth` (null while fewer than k are found). A list lies in the
    order if it meets a window; it matters if it can hold the k-th score of a window that it meets.
    """
    shared = queries.sparkSession.sparkContext.broadcast(lists)  # at most MOST_LISTS lists
    names = ["key", "own", "label", "v", "low", "high", "kth"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                key, own, label, v, low, high, kth = (b.column(i) for i in range(7))
                under, over = bounds(matrix(v, width), shared.value)
                order = np.argsort(-over, axis=1, kind="stable")
                rows, homes = [], []
                for i, (lo, hi, best) in enumerate(zip(low.to_pylist(), high.to_pylist(), kth.to_pylist(), strict=True)):
                    meets = np.zeros(over.shape[1], bool)
                    matters = np.zeros(over.shape[1], bool)
                    for x, y, z in zip(lo, hi, best, strict=True):
                        met = (over[i] >= x) & (under[i] <= y) & (shared.value.held > 0)
                        meets |= met
                        matters |= met & (over[i] >= (x if z is None else z))
                    there = order[i][meets[order[i]]][first:end]
                    there = there[matters[there]]
                    rows += [i] * len(there)
                    homes += there.tolist()
                if rows:
                    at = pa.array(rows, pa.int64())
                    floor = [[x if z is None else max(x, z) for x, z in zip(lo, best, strict=True)] for lo, best in zip(low.to_pylist(), kth.to_pylist(), strict=True)]
                    out = [key, own, label, v, pa.array(floor, pa.list_(pa.int64())), high]
                    yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int32()), *[c.take(at) for c in out]], names=["list", *names[:-1]])

    return queries.select(*names).mapInArrow(choose, "list int, key long, own long, label long, v array<long>, low array<long>, high array<long>")


def hits(blocks: DataFrame, asked: DataFrame, cuts: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """(key, window, score, vec_id, label): the k best rows of each block for each window of each query that visits its list.

    A block's rows come before its queries in a sorted partition: one block is held, and queries pass by.
    """
    none = lambda t: F.lit(None).cast(t)
    rows = blocks.select("list", "block", F.lit(0).alias("kind"), F.col("vec_id").alias("key"), none("long").alias("own"), "label", "v", none("array<long>").alias("low"), none("array<long>").alias("high"))
    dealt = asked.join(F.broadcast(cuts), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = dealt.select("list", F.col("block").cast("int").alias("block"), F.lit(1).alias("kind"), "key", "own", "label", "v", "low", "high")
    both = rows.unionByName(asks).repartition("list", "block").sortWithinPartitions("list", "block", "kind")

    def best(score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Places of the k best, by score, id and label."""
        at = np.arange(len(score))
        if len(score) > 4 * k:
            at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.lexsort((labels[at], ids[at], ~score[at]))[:k]]

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, x, ids, labels, null = None, [], None, None, None, None
        for batch in batches:
            home = batch.column(0).to_numpy().astype(np.int64) * (1 << 32) + batch.column(1).to_numpy()
            kind = batch.column(2).to_numpy()
            edge = np.flatnonzero((np.diff(home) != 0) | (np.diff(kind) != 0)) + 1
            out: list[tuple] = []
            for a, e in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
                if a == e:
                    continue
                b = batch.slice(a, e - a)
                if home[a] != at:
                    at, parts, x = home[a], [], None
                if kind[a] == 0:
                    parts.append(b)
                    continue
                if x is None and parts:
                    x = np.concatenate([matrix(p.column(6), width) for p in parts])
                    keys = pa.concat_arrays([p.column(3) for p in parts])
                    null = keys.is_null().to_numpy(zero_copy_only=False)
                    ids = np.where(null, HIGH, keys.fill_null(HIGH).to_numpy())
                    labels = np.concatenate([p.column(5).to_numpy() for p in parts])
                    parts = []
                if x is None:
                    continue
                for i in range(0, b.num_rows, 128):
                    part = b.slice(i, 128)
                    scores = products(matrix(part.column(6), width), x)
                    for key, own_id, label, low, high, score in zip(*(part.column(c).to_pylist() for c in (3, 4, 5, 7, 8)), scores, strict=True):
                        other = True if own_id is None else (ids != own_id) | null
                        mine = np.flatnonzero(((labels == label) == same) & other)
                        near = score[mine]
                        for w, (lo, hi) in enumerate(zip(low, high, strict=True)):
                            own = mine[(near >= lo) & (near <= hi)]
                            if len(own):
                                for j in own[best(score[own], ids[own], labels[own])].tolist():
                                    out.append((key, w, int(score[j]), None if null[j] else int(ids[j]), int(labels[j])))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "window", "score", "vec_id", "label"])

    return both.mapInArrow(pass_by, "key long, window int, score long, vec_id long, label long")


def search(queries: DataFrame, blocks: DataFrame, cuts: DataFrame, lists: Lists, width: int, k: int, same: bool) -> DataFrame:
    """(key, window, score, vec_id, label, rank): the k best rows of the same label, or of other labels, for each window of each query.

    `queries`: key, `own` (an id whose rows don't count, or null), label, v and the arrays `low`, `high`, a window each.
    """
    order = Window.partitionBy("key", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "label")
    best, first, end = None, 0, FIRST
    while first < len(lists.radii):
        if best is None:
            now = queries.withColumn("kth", F.transform("low", lambda _: F.lit(None).cast("long")))
        else:
            full = best.groupBy("key", "window").agg(F.when(F.count("*") >= k, F.min("score")).alias("score")).where("score is not null")
            known = full.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("known"))  # a window each
            at = lambda _, i: F.try_element_at(F.col("known"), i)
            now = queries.join(known, "key", "left").withColumn("kth", F.transform("low", at))
        asked = cut(visits(now, lists, width, first, end))
        if not asked.isEmpty():
            found = hits(blocks, asked, cuts, width, k, same)
            found = found if best is None else best.drop("rank").unionByName(found)
            best = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        first, end = end, end * STEP
    if best is None:
        best = queries.sparkSession.createDataFrame([], "key long, window int, score long, vec_id long, label long, rank int")
    return best


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from `prepared` rows (vec_id, label, v).

    Of each anchor and each of its first `positives`, the first `negatives` of other labels whose score is at least
    `share` per cent of the positive's and at most the positive's.
    """
    spark = rows.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = cut(rows.select("vec_id", "label", "v"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size.n:
        return spark.createDataFrame([], out)
    width = max(1, size.width)
    rows = rows.withColumn("v", F.when(F.size("v") < width, F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))).otherwise(F.col("v")))
    centroids = fitted(rows, size.n, width)
    homes = cut(listed(rows, centroids, width))
    sums = homes.groupBy("list").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()  # a row for each list
    radii, held = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in sums:
        radii[r.list], held[r.list] = r.radius, r.n
    lists = Lists(centroids, radii, held)
    cuts = spark.createDataFrame([(r.list, -(-r.n // BLOCK)) for r in sums], "list int, blocks int")
    place = F.pmod(F.xxhash64("vec_id", "v", "label"), F.col("blocks"))
    blocks = homes.join(F.broadcast(cuts), "list").select("list", place.cast("int").alias("block"), "vec_id", "label", "v")

    anchors = cut(homes.where(is_anchor & F.col("vec_id").isNotNull()).select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").alias("anchor_id"), "label", "v"))
    every = lambda x: F.array(F.lit(x).cast("long"))
    near = search(anchors.select("key", F.col("anchor_id").alias("own"), "label", "v", every(LOW).alias("low"), every(HIGH).alias("high")), blocks, cuts, lists, width, positives, True)
    pairs = cut(near.select("key", F.col("rank").alias("turn"), "score", F.col("vec_id").alias("positive_id")).join(anchors, "key"))
    # at a negative score, 80 % of it is above it: no score lies in between
    windows = pairs.where("score >= 0").groupBy("key", "label", "v").agg(F.array_sort(F.collect_list(F.struct("turn", "score"))).alias("w"))
    # the least score n with share * score <= 100 * n, without a product that could overflow
    least = F.expr(f"transform(w, x -> x.score - ((x.score div 100) * {100 - share} + (x.score % 100) * {100 - share} div 100))")
    asks = windows.select("key", F.lit(None).cast("long").alias("own"), "label", "v", least.alias("low"), F.transform("w", lambda x: x["score"]).alias("high"), F.transform("w", lambda x: x["turn"]).alias("turns"))
    asks = cut(asks)
    found = search(asks.drop("turns"), blocks, cuts, lists, width, negatives, False)
    named = found.select("key", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(asks.select("key", "turns"), "key")
    named = named.select("key", F.element_at("turns", F.col("window") + 1).alias("turn"), "rank", "negative_id", "negative_score")
    done = named.join(pairs.select("key", "turn", "anchor_id", "positive_id", F.col("score").alias("positive_score")), ["key", "turn"])
    return done.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


#: The same, by brute force.
OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label AND vec_id IS DISTINCT FROM anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
   AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
