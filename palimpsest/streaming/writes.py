"""Writing a batch to several tables as one: a batch counts once its commit record is there, and is written once however often it comes.

Each table has a folder for each batch, which a repeated batch replaces; the commit record is written last, with the rows of
each table, counted while they are written. Readers see committed batches only, so a batch that failed between two tables
is not there, and its replay leaves no row twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

COMMIT = "table string, rows long"


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def committed(spark: SparkSession, root: str) -> DataFrame:
    """(batch, table, rows) of the batches that count."""
    if not _there(spark, f"{root}/commits"):
        return spark.createDataFrame([], f"batch long, {COMMIT}")
    return spark.read.option("basePath", f"{root}/commits").schema(f"{COMMIT}, batch long").parquet(f"{root}/commits").select("batch", "table", "rows")


def read(spark: SparkSession, root: str, table: str, layout: str) -> DataFrame:
    """A table's rows of all batches that count, with the `batch` of each."""
    if not _there(spark, f"{root}/{table}"):
        return spark.createDataFrame([], f"{layout}, batch long")
    rows = spark.read.option("basePath", f"{root}/{table}").schema(f"{layout}, batch long").parquet(f"{root}/{table}")
    return rows.join(committed(spark, root).select("batch").distinct(), "batch", "left_semi").select(*rows.columns)


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """Of each key the row of the last batch."""
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("batch")))
    return rows.withColumn("__n", turn).where("__n = 1").drop("__n")


def commit(spark: SparkSession, root: str, batch: int, tables: dict[str, DataFrame]) -> bool:
    """Writes the tables' rows of a batch, then its commit record; a batch that counts already is left alone (False)."""
    if not committed(spark, root).where(F.col("batch") == batch).isEmpty():
        return False
    counts = []
    for name, rows in tables.items():
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
        counts.append((name, seen.get["rows"]))
    spark.createDataFrame(counts, COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/batch={batch}")
    return True


def sink(root: str, work: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: what `work` makes of a batch, written as one. A batch that counts is not worked on again."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if committed(spark, root).where(F.col("batch") == batch).isEmpty():
            commit(spark, root, batch, work(rows))

    return write
