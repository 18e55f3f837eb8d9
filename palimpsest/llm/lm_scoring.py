"""LM scoring: a gated recurrent model's log-likelihood of whole documents, next to a smoothed unigram model's.

1. Tokens (64-bit hashes of lower-cased words, and one end a text) are counted over all learning documents; tasks
   add up their own before the shuffle.
2. The most frequent tokens, about `heavy`, go to all tasks; the first of them are the recurrent model's
   words. It is trained on all learning documents, each in one of the rounds: a round's documents are dealt by a hash
   into shares of about `share` tokens, whatever files they lie in, each share trains a model of its own, the models are
   averaged AVERAGES at a time until one is left, and the next round starts from the average.
3. One pass scores every text whole. A token that the model has no word for scores as the model's `unknown` times its
   smoothed share of all such tokens; the counts of those not among the heavy ones are joined by token, a few
   per cent of the corpus, and are needed for both scores.

score = sum over tokens of log10 P(word | all before it); base_score = sum of log10((c + 0.5) / (N + 0.5 (V + 1))).

Defined results: a null or wordless text is its end alone. A null id is in no fold: it is not held out, and learnt
from. Repeated rows count as often as they stand there and come back as often. With no learning documents N and V are
0 and every base score is 0. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import gru
from palimpsest.llm.base import cut, fold, table
from palimpsest.llm.text import Buffer, pieces

U64 = np.uint64
#: The end of a text as a token: no word hashes to it but by a chance of 2^-64.
END = U64(0x0E0F0E0F0E0F0E0F)
#: Shares whose models a task averages.
AVERAGES = 8
#: Into how many parts a hash deals the tokens of the count up to which the heavy ones go.
PARTS = 1 << 20


@dataclass(frozen=True)
class Plan:
    """Fixed sizes: heavy tokens, rounds that the learning documents are dealt to, tokens of a local model."""

    heavy: int = 1 << 17
    rounds: int = 2
    share: int = 1 << 20
    shape: gru.Shape = gru.Shape()


def _tokens(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts: tokens end to end, an end after each text, and offsets."""
    for a, z in pieces(texts, 1 << 20):
        b = Buffer(texts[a:z])
        start, end, doc = b.spans()
        first = np.searchsorted(doc, np.arange(1, z - a + 1))
        yield a, z, np.insert(b.hashes(start, end), first, END), np.concatenate([[0], first + np.arange(1, z - a + 1)])


def token_counts(learning: DataFrame) -> DataFrame:
    """(token, n) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0

            def total(held: list[np.ndarray]) -> pa.RecordBatch:
                u, n = np.unique(np.concatenate(held), return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

            for _, _, t, _ in _tokens(batch.column(0).to_pylist()):
                held.append(t)
                size += len(t)
                if size > 4_000_000:
                    yield total(held)
                    held, size = [], 0
            if held:
                yield total(held)

    return learning.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The heavy tokens in the order of their hashes, and each one's number in the recurrent model (0: unknown)."""

    tokens: np.ndarray
    log_count: np.ndarray
    number: np.ndarray
    unknown: int
    end: int
    log_all: float
    log_unknown: float

    def look_up(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the heavy tokens, whether it is there)."""
        if not len(self.tokens):
            return np.zeros(len(t), np.int64), np.zeros(len(t), bool)
        at = np.minimum(np.searchsorted(self.tokens, t), len(self.tokens) - 1)
        return at, self.tokens[at] == t

    def numbers(self, t: np.ndarray) -> np.ndarray:
        at, there = self.look_up(t)
        return np.where(there, self.number[at], self.unknown) if len(self.tokens) else np.full(len(t), self.unknown)


def vocabulary(counts: DataFrame, plan: Plan) -> tuple[Vocabulary, np.ndarray, int, int]:
    """(vocabulary, the model's word counts by number, N, V); about `heavy` rows come to the driver.

    The heavy tokens are the most frequent ones. A histogram of the counts' logarithms, at most 1024 rows, tells from which
    step on they all fit; of the step before it those with a small hash fill the room, however many tokens share it.
    No task sorts or gathers the tokens of all.
    """
    step = F.floor(F.log2("n") * 16)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect()
    total, distinct = sum(r.n for r in steps), sum(r.kinds for r in steps)
    least, part, room = 0, PARTS, plan.heavy
    for r in sorted(steps, key=lambda r: -r.step):
        least, part = r.step, min(PARTS, PARTS * room // r.kinds)
        room -= r.kinds
        if room <= 0:
            break
    among = (F.col("token") == F.lit(int(END.view(np.int64)))) | (step > least) | ((step == least) & (F.pmod(F.xxhash64("token"), F.lit(PARTS)) < part))
    top = counts.where(among).toArrow()
    tokens, n = top.column(0).to_numpy().view(U64), top.column(1).to_numpy().astype(np.int64)
    order = np.lexsort((tokens, -n))
    tokens, n = tokens[order], n[order]
    words = plan.shape.words
    # the most frequent of them, the end and the unknown are the words; the rest of the heavy ones are unknown
    own = np.flatnonzero(tokens != END)[: words - 2]
    ends = int(n[tokens == END].sum())
    left = total - int(n[own].sum()) - ends
    weight = np.concatenate([[left, ends], n[own], np.zeros(words - 2 - len(own), np.int64)])
    rank = np.empty(words, np.int64)
    order = np.argsort(-weight, kind="stable")
    rank[order] = np.arange(words)
    number = np.full(len(tokens), rank[0])
    number[own] = rank[2 : 2 + len(own)]
    number[tokens == END] = rank[1]
    s = np.argsort(tokens)
    kinds = max(0, distinct - len(own) - 1)
    v = Vocabulary(tokens[s], np.log10(n[s] + 0.5), number[s], int(rank[0]), int(rank[1]), float(np.log10(total + 0.5 * (distinct + 1))), float(np.log10(left + 0.5 * (kinds + 1))))
    return v, weight[order], total, distinct


def _averaged(models: list[tuple[gru.Params, float]]) -> tuple[gru.Params, float] | None:
    total = sum(w for _, w in models)
    return ({k: sum((m[k] * (w / total) for m, w in models)).astype(np.float32) for k in models[0][0]}, total) if total else None


def trained(learning: DataFrame, start: gru.Params, words: Vocabulary, plan: Plan, total: int) -> gru.Params:
    """Rounds of local training and weighted averaging; each of the learning documents, of `total` tokens, is in one round.

    A task cuts what it has into models of one to two shares, so that rows that all hash alike stay bounded in memory.
    """
    spark = learning.sparkSession
    pick = F.pmod(F.xxhash64("doc_id", "text", F.lit(19)), F.lit(plan.rounds))
    tasks = max(1, round(total / plan.rounds / plan.share))
    for turn in range(plan.rounds):
        shared = spark.sparkContext.broadcast((start, words))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, w = shared.value  # noqa: B023
            texts, size = [], 0

            def one() -> pa.RecordBatch:
                blob = pickle.dumps((gru.train(model, texts, w.end, plan.shape), float(size)))
                return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["model"])

            for batch in batches:
                for _, _, t, off in _tokens(batch.column(0).to_pylist()):
                    n = w.numbers(t)
                    for i in range(len(off) - 1):
                        texts.append(n[off[i] : off[i + 1]])
                        size += len(texts[-1])
                        if size >= 2 * plan.share:
                            yield one()
                            texts, size = [], 0
            if texts:
                yield one()

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: tuple[gru.Params, float] | None = None
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    one = pickle.loads(blob)
                    held = one if held is None else _averaged([held, one])
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["model"])

        # dealt anew, so that a task's share is a mix of the corpus, in an order that the files don't decide
        dealt = learning.where(pick == turn).select("text", F.xxhash64("text", "doc_id", F.lit(23)).alias("__deal"))
        dealt = dealt.repartition(tasks, "__deal").sortWithinPartitions("__deal").select("text")
        models = cut(dealt.mapInArrow(local, "model binary"))
        left = tasks
        while True:
            left = -(-left // AVERAGES)
            models = models.repartition(left).mapInArrow(average, "model binary")
            if left == 1:
                break
        mean = models.first()
        start = pickle.loads(mean.model)[0] if mean else start
    return start


def lm_scores(docs: DataFrame, learn, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`; learns from rows where `learn`."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    learning = docs.where(learn)
    counts = cut(token_counts(learning))
    words, weight, total, _ = vocabulary(counts, plan)
    model = trained(learning, gru.initial(weight, plan.shape), words, plan, total)
    shared = spark.sparkContext.broadcast((model, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, w = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens, offsets = [], [np.zeros(1, np.int64)]
            at = 0
            for _, _, t, off in _tokens(texts):
                tokens.append(t)
                offsets.append(off[1:] + at)
                at += len(t)
            if not texts:
                continue
            t, off = np.concatenate(tokens), np.concatenate(offsets)
            place, there = w.look_up(t)
            number = np.where(there, w.number[place], w.unknown) if len(w.tokens) else np.full(len(t), w.unknown)
            logs = np.where(there, w.log_count[place], 0.0) if len(w.tokens) else np.zeros(len(t))
            rare = number == w.unknown
            add = lambda x: np.add.reduceat(x, off[:-1])  # noqa: B023, E731  no text is without its end
            cold = np.flatnonzero(~there)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(cold, off).astype(np.int32)), pa.array(t[cold].view(np.int64)))
            found = {
                "n_tokens": np.diff(off), "n_heavy": add(there.astype(np.int64)), "n_rare": add(rare.astype(np.int64)),
                "log_heavy": add(logs), "log_rare": add(np.where(rare, logs, 0.0)),
                "recurrent": gru.score(model, number, off, w.end, plan.shape) / np.log(10),
            }
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values()), lists], names=["doc_id", *found, "cold"])

    kind = "doc_id long, n_tokens long, n_heavy long, n_rare long, log_heavy double, log_rare double, recurrent double, cold array<long>"
    scored = cut(docs.mapInArrow(run, kind)).withColumn("row", F.monotonically_increasing_id())
    asked = scored.select("row", F.explode("cold").alias("token")).join(counts, "token", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    joined = asked.groupBy("row").agg(F.sum(F.log10(n + 0.5)).alias("log_cold"), F.count("n").alias("known_cold"))
    cold = F.coalesce(F.col("log_cold"), F.lit(0.0))
    return scored.drop("cold").join(joined, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_heavy") + F.coalesce(F.col("known_cold"), F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("log_heavy") + cold - F.col("n_tokens") * F.lit(words.log_all)).alias("base_score"),
        (F.col("recurrent") + F.col("log_rare") + cold - F.col("n_rare") * F.lit(words.log_unknown)).alias("score"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold() == 1, F.lit(False))
    done = lm_scores(table(spark, sf_dir, "documents"), ~held_out)
    return done.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
