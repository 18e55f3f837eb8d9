"""The corpus pipeline: toxicity, quality, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. The first four return the columns
of documents; the last returns the packed pieces. Rows whose id is null stay in the filtering stages like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import classify, mixing, near_dedup, packing
from palimpsest.llm.base import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in COLUMNS if c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score >= 0.5) go; learnt from labelled rows of `docs`."""
    docs = _columns(docs)
    done = classify.toxicity(docs, docs, table(spark, sf_dir, "labels"), out="__score")
    return done.where("__score < 0.5").drop("__score")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects (score < 0.3) go; learnt from labelled rows of `docs`."""
    docs = _columns(docs)
    done = classify.quality(docs, docs, table(spark, sf_dir, "labels"), out="__score")
    return done.where("__score >= 0.3").drop("__score")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the row with its smallest id. Five words, similarity 0.8.

    Rows repeated with the same id and text are one document; different texts that share an id are documents of their
    own, and the smaller hash goes first. Wordless texts and null ids group with nothing.
    """
    docs = _columns(docs).withColumn("__hash", F.xxhash64("text"))
    known = docs.where("doc_id is not null")
    found = near_dedup.near_dedup(known, ngram=5, percent=80).select("doc_id", F.col("text_hash").alias("__hash"), "component")
    grouped = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "__hash")).alias("x")).select("x.*")
    kept = grouped.unionByName(found.where("component is null").select("doc_id", "__hash").distinct())
    # of a row repeated very often each task keeps one before they meet
    rest = [c for c in ("source", "lang", "n_chars", "text") if c in docs.columns]
    rows = known.join(kept, ["doc_id", "__hash"], "left_semi").groupBy("doc_id", "__hash").agg(F.min(F.struct(*rest)).alias("x")).select("doc_id", "x.*")
    names = [c for c in COLUMNS if c in docs.columns]
    return rows.select(*names).unionByName(docs.where("doc_id is null").select(*names))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources holds them."""
    return mixing.repeated(_columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 1024 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", dedup),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

#: Trained models and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what one returns is stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
