"""Toxicity (subword bags) and quality (hashed n-grams with FTRL): fit on labelled rows, score whole texts.

Both models are fitted in one executor task on a bounded sample of labelled rows; the bound is the parameter
`per_label`. The fitted model has a fixed size, goes to the tasks as a broadcast, and every text is scored whole.

Defined results: a null or empty text has no features and gets the score of the bias; with no labelled rows
(or labels of one kind only) nothing can be learnt, and every text gets the score `unlearnt`, which keeps it.
Documents that share an id with others are scored each by its own text; such an id's label is learnt once, with the
smallest of its texts, and as 1 if its labels differ. Ties cannot arise. Extra columns of the input stay as they are; a
column that has the result's name, in any case, is replaced by the result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import ftrl, subword
from palimpsest.llm.base import fold, table, with_column


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, seed: int = 5) -> DataFrame:
    """(label, text) of at most `per_label` documents of either label, none of fold 0, picked by a hash of the id."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold() != 0))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .withColumn("__pos", F.xxhash64("doc_id", F.lit(seed)))
    )
    there = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    few = None
    for y in (0, 1):
        # hashes below this are about twice as many as are wanted, so that the limit's one task reads no more than that
        top = min(1.0, 2 * per_label / max(1, there.get(y, 0)))
        near = F.lit(True) if top == 1.0 else F.col("__pos") < F.lit(int((top - 0.5) * 2**64))
        part = known.where((F.col("label") == y) & near).orderBy("__pos", "doc_id").limit(per_label)
        few = part if few is None else few.unionByName(part)
    # at most 2 * per_label ids: a proven bound for the broadcast
    met = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    # repeated rows of an id count once
    return met.groupBy("doc_id", "label", "__pos").agg(F.min("text").alias("text")).select("label", "text", "__pos", "doc_id")


def fit(sample: DataFrame, model: ModuleType, shape: object) -> tuple[np.ndarray, float] | None:
    """Trains in one task; returns the weights, whose size `shape` fixes, or None if there is nothing to learn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
        rows.sort(key=lambda r: (r[2], r[3]))
        y = np.array([r[0] for r in rows], np.int64)
        blob = pickle.dumps(model.train([r[1] for r in rows], y, shape)) if len(set(y.tolist())) == 2 else b""
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["model"])

    blobs = [r.model for r in sample.repartition(1).mapInArrow(run, "model binary").collect() if r.model]
    return pickle.loads(blobs[0]) if blobs else None


def scored(docs: DataFrame, fitted: tuple[np.ndarray, float] | None, model: ModuleType, shape: object, unlearnt: float, text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of `docs`, with the probability of label 1 as `out`."""
    docs = docs.drop(out)  # whatever its case
    if fitted is None:
        return docs.withColumn(out, F.lit(unlearnt))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def score(texts: list) -> list:
        z = model.log_odds(texts, *shared.value, shape)
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist()

    return with_column(docs, out, "double", text, score)


def _query(spark: SparkSession, sf_dir: str, score: Callable, least: float) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = score(docs, docs, table(spark, sf_dir, "labels"))
    return done.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, corpus: DataFrame, labels: DataFrame, per_label: int = 2500, shape: subword.Shape = subword.Shape(), out: str = "score") -> DataFrame:
    """`docs` with the probability that a text is toxic; learnt from labelled texts of `corpus`."""
    return scored(docs, fit(labelled_sample(corpus, labels, "toxic", per_label), subword, shape), subword, shape, 0.0, out=out)


def quality(docs: DataFrame, corpus: DataFrame, labels: DataFrame, per_label: int = 2500, shape: ftrl.Shape = ftrl.Shape(), out: str = "score") -> DataFrame:
    """`docs` with the probability that a text is of good quality; learnt from labelled texts of `corpus`."""
    return scored(docs, fit(labelled_sample(corpus, labels, "quality", per_label), ftrl, shape), ftrl, shape, 1.0, out=out)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, toxicity, 0.5)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, quality, 0.3)
