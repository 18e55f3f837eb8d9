"""The fold and what follows extraction's windows are much work for few bytes: all shuffle partitions share it."""

from pyspark.sql import functions as F

from palimpsest.operators import dependencies, extract, fold
from palimpsest.sources.schemas import ITEM
from palimpsest.sources.tables import normalized


def messages(spark):
    rows = spark.range(60).select(F.col("id").cast("string").alias("user_id"), F.explode(F.array(F.lit("P uses Neon for database"), F.lit("I love red"))).alias("content"))
    return normalized(rows.withColumns({"ordinal": F.length("content"), "role": F.lit("user")}))


def parts(frame):
    return [r["n"] for r in frame.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).where("n > 0").collect()]


def test_few_bytes_are_folded_by_all_tasks(spark):
    told = extract.routed(extract.candidates(messages(spark)))
    assert len(parts(told)) == 4
    ready = fold.prepared(told.where("bucket = 'store'"), ["ordinal", "sentence", "part"])
    assert len(parts(fold.fold(ready))) == 4
    old = spark.createDataFrame([], ITEM)
    assert len(parts(fold.fold(ready, old))) == 4


def test_groups_are_whole_where_batches_end(spark, monkeypatch):
    """A user's candidates pass by in slices; its group is one, and more rows come back than a batch holds."""
    monkeypatch.setattr(fold, "SLICE", 2)
    ready = fold.prepared(extract.routed(extract.candidates(messages(spark))), ["ordinal", "sentence", "part"])
    got = fold.fold(ready).groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.max("id").alias("id")).collect()
    assert len(got) == 120 and {(r.kind, r.n, r.id) for r in got} == {("action", 2, 2), ("item", 2, 2)}


def test_components_are_folded_by_all_tasks(spark):
    ready = fold.prepared(dependencies.numbered(extract.routed(extract.candidates(messages(spark))), ["ordinal", "sentence", "part"]), [])
    told, known = dependencies.dealt(ready, spark.createDataFrame([], ITEM))
    rows = fold.grouped(told.toDF(*told.columns), known.toDF(*known.columns), "user_id", "component", apart=dependencies.APART)
    assert len(parts(rows)) == 4
