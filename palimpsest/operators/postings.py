"""Postings of three-character grams over the memory's searched fields: what a term may occur in, without reading the memory.

The postings are a table of their own, (gram, user_id, id), in folders by the gram's hash and sorted by gram within files, so
a search reads the folders of its grams and, of their files, the row groups that hold them. What has all grams of a term is
read from the memory and tested with `contains`: results are those of the plain search. A term of fewer than three characters
has no gram; a search with one tests the whole memory.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.retrieve import holds

FIELDS = ("content", "value", "predicate", "subject", "topic_key")
FOLDERS = 64


def postings(items: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(folder, gram, user_id, id): each gram of the fields once for each item; fields don't run into one another."""
    each = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3)))
    grams = [F.when(F.length(c) >= 3, each(F.col(c))).otherwise(F.array().cast("array<string>")) for c in fields]
    rows = items.select("user_id", "id", F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(g, F.array().cast("array<string>")) for g in grams])))).alias("gram"))
    return rows.select(_folder(F.col("gram")).alias("folder"), "gram", "user_id", "id")


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def write(items: DataFrame, path: str, fields: Sequence[str] = FIELDS) -> None:
    rows = postings(items, fields)
    rows.repartition("folder", "gram").sortWithinPartitions("folder", "gram", "user_id").write.mode("overwrite").partitionBy("folder").parquet(path)


def wanted(table: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(user_id, id) of items that hold all grams of one of the terms, all of three characters at least."""
    found = None
    for t in terms:
        grams = sorted({t[i : i + 3] for i in range(len(t) - 2)})
        folders = [_folder(F.lit(g)) for g in grams]  # constants when the plan is made
        own = table.where(F.col("folder").isin(*folders) & F.col("gram").isin(grams)).groupBy("user_id", "id").agg(F.count("*").alias("n"))
        own = own.where(F.col("n") == len(grams)).select("user_id", "id")
        found = own if found is None else found.unionByName(own)
    return found.distinct()


def search(items: DataFrame, table: DataFrame, terms: Sequence[str], fields: Sequence[str] = FIELDS) -> DataFrame:
    """Items that hold any of the terms in any of the fields; `table`: their postings."""
    terms = [t.strip() for t in terms if t.strip()]
    hit = reduce(lambda a, b: a | b, [holds(fields, t) for t in terms], F.lit(False))
    if terms and all(len(t) >= 3 for t in terms):
        items = items.join(wanted(table, terms), ["user_id", "id"], "left_semi")
    return items.where(hit)
