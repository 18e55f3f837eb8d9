"""The functions that Spark lacks, under names for SQL texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.scoring import similarity_of
from palimpsest.operators.compile import knapsack


def register(spark: SparkSession) -> None:
    """`lcs_ratio(a, b)`: the similarity of two texts; `nfkc(text)`: compatibility composition; `knapsack(costs, values, capacity)`: places, from
    0, of the items that a budget is best spent on (two arrays of one length, and a number). Nulls give null.
    """

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else similarity_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    def composed(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    def packed(costs: pd.Series, values: pd.Series, capacity: pd.Series) -> pd.Series:
        one = lambda c, v, n: None if c is None or v is None or pd.isna(n) else knapsack(np.asarray(c, np.int64), np.asarray(v, float), int(n)).astype(np.int32)
        return pd.Series([one(*x) for x in zip(costs, values, capacity, strict=True)])

    spark.udf.register("lcs_ratio", F.pandas_udf(ratio, "double"))
    spark.udf.register("nfkc", F.pandas_udf(composed, "string"))
    spark.udf.register("knapsack", F.pandas_udf(packed, "array<int>"))
