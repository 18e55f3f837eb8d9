"""Heavy work on tables of few bytes is dealt to tasks, filters and all."""

from pyspark.sql import functions as F

from palimpsest.sources import tables


def one_file(spark, path, rows):
    c = spark.range(rows, numPartitions=1).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("I use Neon "), "id").alias("text"))
    c.write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_messages_of_one_file_are_many_tasks(spark, tmp_path):
    d = one_file(spark, tmp_path, 4 * tables.HEAVY_ROWS)
    got = tables.conversation_messages(spark, d).where(F.length("content") > 0).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in got.groupBy("part").count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 4 * tables.HEAVY_ROWS and max(sizes) <= 2 * tables.HEAVY_ROWS
    # what filters the messages runs behind the dealing, not in the scan's one task
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Repartition") and "Filter" not in plan[plan.index("Repartition") :]
