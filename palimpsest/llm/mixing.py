"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Every source gets its weight's share of the mix, but at most `epochs` times its own size; what a capped source
can't take goes to the others by weight, until none is above its cap. A source's documents are then repeated
a whole number of times, and a further part of them, chosen by a seeded hash, once more; the document at the
edge of that part is taken in part, so that the source's words equal its target rounded to a word.

Defined results: a null or wordless text has size 0 and takes 0; a null source is a source of its own, last in
order; a null id is an id like any other. Repeated rows share what their group takes, each at most `epochs` times
its size. A weight that is null or not positive counts as 0: its source takes nothing unless all weights do.
With no words at all every target is 0. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.base import WORD, cut, earlier, numbered, table, unrolled


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, volume: float, epochs: int) -> float:
    """The level L at which the targets least(weight * L, epochs * size) add up to `volume` (or all are capped).

    `sources` (size, weight). A round caps every source that the present level would overfill and shares the
    rest among the others; a source once capped stays so, and only two sums reach the driver in each round.
    """
    cap = epochs * F.col("source_size")
    level = -1.0
    while True:
        capped = F.col("weight") * F.lit(level) >= cap
        row = sources.where("weight > 0").agg(F.sum(F.when(capped, cap)).alias("held"), F.sum(F.when(~capped, F.col("weight"))).alias("free"), F.count("*")).first()
        if not row.free:
            return max(level, 0.0) if row.held is None else float("inf")
        now = max(0.0, (volume - (row.held or 0)) / row.free)
        if now <= level:
            return level
        level = now


def targets(sizes: DataFrame, weigh: Callable[[DataFrame], DataFrame], share: float, epochs: int) -> DataFrame:
    """(source, source_size, weight, target) of every source of `sizes` (source, words)."""
    sources = cut(weigh(sizes.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumn("weight", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))))
    total = sources.agg(F.sum("source_size").alias("n")).first().n or 0
    level = water_level(sources, share * total, epochs)
    cap = (epochs * F.col("source_size")).cast("double")
    wanted = F.when(F.col("weight") > 0, cap if level == float("inf") else F.least(F.col("weight") * F.lit(level), cap)).otherwise(0.0)
    return sources.withColumn("target", wanted)


def cycle(weights: tuple[float, ...] = (3, 1, 2)) -> Callable[[DataFrame], DataFrame]:
    """Weights dealt out in turn to the sources in code-point order, null last."""

    def weigh(sources: DataFrame) -> DataFrame:
        ranked = numbered(sources, "source", "rank")
        return ranked.withColumn("weight", F.element_at(F.array([F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)).drop("rank")

    return weigh


def mix(docs: DataFrame, weigh: Callable[[DataFrame], DataFrame] | None = None, share: float = 1.5, epochs: int = 2, seed: int = 23) -> DataFrame:
    """One row for each row of `docs` (doc_id, source, text): doc_id, source, size, source_size, target, copies, part, taken.

    `copies` whole repetitions and `part` words of one more; taken = copies * size + part.
    """
    rows = docs.select("doc_id", "source", word_count().alias("size"))
    # rows alike are one group, so that a row repeated very often is no hot key
    groups = cut(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    groups = groups.withColumns({"words": F.col("n") * F.col("size"), "pos": F.xxhash64("doc_id", "size", F.lit(seed))})
    goal = targets(groups, weigh or cycle(), share, epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "of")
    placed = earlier(groups, ["source"], "pos", ["doc_id", "size"], F.col("words"), "before")
    placed = unrolled(placed, "n", "i", "pos").join(goal, F.col("source").eqNullSafe(F.col("of")))
    extra = F.least(F.greatest(F.col("rest") - F.col("before") - F.col("i") * F.col("size"), F.lit(0)), F.col("size"))
    full = (extra == F.col("size")) & (F.col("size") > 0)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") + full.cast("long")).alias("copies"), F.when(full, 0).otherwise(extra).alias("part"), (F.col("whole") * F.col("size") + extra).alias("taken"),
    )


def repeated(docs: DataFrame, **how) -> DataFrame:
    """`docs` as the mix holds them: each row as often as it is taken; one taken in part counts from half its size on."""
    keys = [F.xxhash64("doc_id", "source", "size", F.col("doc_id").isNull(), F.lit(k)).alias(f"__key{k}") for k in (1, 2)]
    times = mix(docs, **how).withColumn("times", F.col("copies") + (2 * F.col("part") >= F.greatest("size", F.lit(1))).cast("long"))
    times = times.groupBy(*keys).agg(F.sum("times").alias("__times"), F.count("*").alias("__alike"))
    named = [k for k in docs.columns if k.lower() == "size"]  # an extra column of that name keeps its values
    sized = docs.withColumnsRenamed({c: f"__own_{c}" for c in named}).withColumn("size", word_count())
    met = sized.withColumns({f"__key{k}": keys[k - 1] for k in (1, 2)}).join(times, ["__key1", "__key2"])
    # of n rows alike that come t times in all, each comes floor(t / n) times and the first t mod n once more
    turn = F.row_number().over(Window.partitionBy("__key1", "__key2").orderBy(F.xxhash64("text")))
    met = met.withColumn("__n", F.floor(F.col("__times") / F.col("__alike")) + (turn <= F.col("__times") % F.col("__alike")).cast("long"))
    met = met.where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return met.select(*[F.col(f"__own_{c}").alias(c) if c in named else F.col(c) for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
