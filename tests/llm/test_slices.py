"""Python workers hold and return few rows at a time, whatever the batches they get."""

import pyarrow as pa

from palimpsest.llm import base


def test_batches_are_cut(spark):
    n = 3 * base.SLICE + 5
    rows = spark.range(n, numPartitions=1).selectExpr("id", "cast(id as string) as text")
    sizes = base.per_batch(rows, "n long", lambda b: {"n": [len(b["id"])] * len(b["id"])})
    assert sorted(r.n for r in sizes.distinct().collect()) == [5, base.SLICE]
    got = base.with_column(rows, "size", "long", "text", lambda texts: [len(texts)] * len(texts))
    assert got.count() == n and sorted(r["size"] for r in got.select("size").distinct().collect()) == [5, base.SLICE]
    assert list(base.slices(iter([pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["x"])]))) == []
