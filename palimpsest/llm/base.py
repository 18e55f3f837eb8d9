"""What the operators of this subpackage share: reading, cutting lineage, and ranks without hot groups."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder of `spark.checkpoint.dir`; a lost executor costs no recomputation.

    Only where that setting is empty and Spark runs in this process alone, as in tests, a folder of this machine is
    used; on a cluster an empty setting is an error. Spark removes what is no longer referred to if
    `spark.cleaner.referenceTracking.cleanCheckpoints` is on.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


#: Rows alike that one task unrolls from their number.
UNROLLED = 1 << 16


def unrolled(df: DataFrame, n: str, out: str, *by: str) -> DataFrame:
    """Each row `n` times with `out` = 0, 1, ..; a row repeated very often is dealt to as many tasks as it needs.

    `by`: columns by which rows are dealt, along with the part of a row's repeats.
    """
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / UNROLLED))
    dealt = df.withColumn("__part", F.explode(parts)).repartition(*by, "__part")
    first = F.col("__part") * UNROLLED
    return dealt.withColumn(out, F.explode(F.sequence(first, F.least(first + UNROLLED, F.col(n)) - 1))).drop("__part")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: which fold a document is of (null ids: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


#: Rows that a Python worker turns into lists at once; what it holds and returns stays as small.
SLICE = 1024


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def per_batch(df: DataFrame, schema: str, f: Callable[[dict[str, list]], dict[str, list] | None]) -> DataFrame:
    """mapInArrow over columns as Python lists: `f` gets the columns of SLICE rows and returns the new ones."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if (out := f(batch.to_pydict())) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def with_column(df: DataFrame, name: str, kind: str, text: str, f: Callable[[list], list]) -> DataFrame:
    """All columns of `df` and one more, computed from its column `text`, SLICE rows at a time."""
    arrow = {"double": pa.float64(), "long": pa.int64()}[kind]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = f(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))]))


def earlier(df: DataFrame, by: list[str], pos: str, ties: list[str], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same group `by` that stand earlier in the order of `pos`, `ties`.

    `pos` is a 64-bit hash. Each group is dealt into 1024 ranges of it, so that a hot group is spread over
    as many tasks; what the earlier ranges hold comes from their totals, at most 1024 rows a group.
    """
    df = df.withColumns({"__range": F.shiftright(pos, 54), "__value": value})
    totals = df.groupBy(*by, "__range").agg(F.sum("__value").alias("__total"))
    totals = totals.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__range").alias("__k"), F.coalesce(F.sum("__total").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    same = F.col("__range") == F.col("__k")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    w = Window.partitionBy(*by, "__range").orderBy(pos, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(totals, same)
        .withColumn(out, F.col("__before") + F.coalesce(F.sum("__value").over(w), F.lit(0)))
        .drop("__range", "__value", "__k", "__before", *[f"__k_{c}" for c in by])
    )


def numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """Adds `out`: 0, 1, .. in the ascending order of the distinct values of `by`, null last, over the whole frame.

    Rows are dealt by ranges of `by` and numbered within each; only the ranges' counts meet in one task.
    """
    key = F.col(by).asc_nulls_last()
    dealt = cut(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    counts = counts.select(F.col("__part"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    w = Window.partitionBy("__part").orderBy(key)
    return dealt.join(counts, "__part").withColumn(out, F.col("__first") + F.row_number().over(w) - 1).drop("__part", "__first")
