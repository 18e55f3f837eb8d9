"""Scores of candidates, messages and memory items as column expressions; similarity of two texts as an Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import lexicons as L
from palimpsest.functions.text import correction_like, keywords, low_info, matches, relevance, speculative, tokens, utterance


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits: a row of the table is one integer."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def similarity_of(a: str, b: str) -> float:
    """2 * LCS / (lengths' sum) of the lower-cased, trimmed texts."""
    a, b = a.lower().strip(), b.lower().strip()
    if a == b:
        return 1.0
    return 2.0 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def similarity(a: Column, b: Column) -> Column:
    """`similarity_of` of two columns, batch by batch."""

    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else similarity_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(each, "double")(a, b)


#: What `str.strip` takes off.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether two texts' lengths allow a similarity of `least`: an exact filter to apply before `similarity`."""
    m, n = F.length(F.trim(F.lower(a), F.lit(WHITE))), F.length(F.trim(F.lower(b), F.lit(WHITE)))
    return F.least(m, n) >= F.greatest(m, n) * F.lit(least / (2 - least))


def similar_pairs(queries: DataFrame, rows: DataFrame, key: str, text: str, least: float, blocks: int = 8) -> DataFrame:
    """(query, key, similarity): whole texts of `queries` and `rows` that are at least `least` alike, each pair met once.

    Both sides are cut into blocks and every pair of blocks is a task's work. Rows repeated with the same key and text are one.
    """
    hashed = lambda df: df.select(key, text).distinct().withColumn("__own", F.pmod(F.xxhash64(key, text), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = hashed(queries).select(F.col(key).alias("query"), F.col(text).alias("__a"), F.col("__own").cast("int").alias("__q"), every.alias("__r"))
    r = hashed(rows).select(key, F.col(text).alias("__b"), F.col("__own").cast("int").alias("__r"), every.alias("__q"))
    by = ["__q", "__r"]
    met = q.repartition(blocks * blocks, *by).hint("merge").join(r.repartition(blocks * blocks, *by), by).where(may_reach(F.col("__a"), F.col("__b"), least))
    # a generator of one row keeps the similarity from being computed for the filter and again for the result
    return met.select("query", key, F.explode(F.array(similarity(F.col("__a"), F.col("__b")))).alias("similarity")).where(F.col("similarity") >= least)


def gain_of(best: float | None) -> float:
    """Information gain from the best similarity with what is known; None: nothing is known."""
    return 0.85 if best is None else 0.05 if best >= 0.92 else 0.25 if best >= 0.75 else 0.8


def information_gain(best: Column) -> Column:
    return F.when(best.isNull(), 0.85).when(best >= 0.92, 0.05).when(best >= 0.75, 0.25).otherwise(0.8)


def importance_of(kind: Column) -> Column:
    types = F.create_map(*[F.lit(x) for kv in L.TYPE_IMPORTANCE.items() for x in kv])
    return F.coalesce(F.try_element_at(types, kind), F.lit(0.6))


def candidate_scores(content: Column, kind: Column, authority: Column, is_correction: Column) -> Column:
    """struct(confidence, importance, stability, freshness) of a candidate."""
    doubt = speculative(content) | (authority == "speculation")
    user = (authority == "user") & ~doubt
    confidence = F.when(user & (kind == "decision"), 0.95).when(user, 0.88).when((authority == "assistant") & ~doubt, 0.7).otherwise(0.55)
    confidence = F.when(doubt, F.least(confidence, F.lit(0.6))).otherwise(confidence)
    confidence = F.when(is_correction | correction_like(content), F.greatest(confidence, F.lit(0.92))).otherwise(confidence)
    confidence = F.when(matches(content, L.DECISION) & user, F.greatest(confidence, F.lit(0.93))).otherwise(confidence)
    importance = F.when(is_correction, F.greatest(importance_of(kind), F.lit(0.9))).otherwise(importance_of(kind))
    stability = F.when(user, 0.55).when(doubt, 0.3).otherwise(0.35)
    return F.struct(F.round(confidence, 3).alias("confidence"), F.round(importance, 3).alias("importance"), F.round(stability, 3).alias("stability"), F.lit(1.0).alias("freshness"))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as the SQL of the queries does: the number itself, scaled; `F.round` goes by its shortest decimals (0.72925 is less than that)."""
    return F.round(x * 10.0**digits) / 10.0**digits


def selection_value(relevance: Column, importance: Column, freshness: Column, confidence: Column, stability: Column, gain: Column) -> Column:
    total = 0.25 * relevance + 0.25 * importance + 0.2 * freshness + 0.1 * confidence + 0.1 * stability + 0.1 * gain
    return rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4)


def message_scores(role: Column, content: Column, index: Column, total: Column, query: Column) -> Column:
    """struct(kind, mandatory, relevance, importance, freshness, confidence, stability, gain) of a message of a request."""
    from_end = total - 1 - index
    fresh = F.greatest(F.lit(0.2), 1.0 - from_end * F.lit(0.08).cast("double"))
    n = utterance(content)
    ack = low_info(content, role) | n.isin(L.LOW_INFO) | (n == "") | F.forall(F.split(n, " "), lambda w: w.isin(L.LOW_INFO))
    tool, user = role == "tool", role == "user"
    importance = F.when(tool, F.when(from_end <= 2, 0.65).otherwise(0.4)).otherwise(F.when(from_end <= 3, 0.85).otherwise(0.5))
    stability = F.when(tool, 0.7).when(user, 0.8).otherwise(0.65)
    decided = matches(content, L.DECISION)
    importance = F.when(ack, 0.05).when(decided, F.greatest(importance, F.lit(0.92))).otherwise(importance)
    stability = F.when(ack, 0.1).when(decided, F.greatest(stability, F.lit(0.9))).otherwise(stability)
    gain = F.when(ack, 0.05).when(from_end <= 2, 0.85).otherwise(0.6)
    confidence = F.when(tool, 0.9).when(user, 0.95).otherwise(0.8)
    system, latest = role == "system", index == total - 1
    pick = lambda s, new, other: F.when(system, s).when(latest, new).otherwise(other)
    return F.struct(
        pick("system", "new_message", F.when(tool, "tool_result").otherwise("message")).alias("kind"), (system | latest).alias("mandatory"),
        pick(0.8, 1.0, relevance(keywords(content), query)).alias("relevance"), pick(1.0, 1.0, importance).alias("importance"), pick(1.0, 1.0, fresh).alias("freshness"),
        pick(1.0, 1.0, confidence).alias("confidence"), pick(1.0, 0.9, stability).alias("stability"), pick(0.9, 0.95, gain).alias("gain"),
    )


def memory_scores(item: dict[str, Column], query: Column) -> Column:
    """The same of a memory item; `item`: its columns by name."""
    own = relevance(keywords(item["content"]), query)
    topic_words = keywords(F.regexp_replace(item["topic_key"], "[._-]", " "))
    bonus = F.when(F.size(F.array_intersect(topic_words, query)) > 0, relevance(keywords(item["topic_key"]), query)).otherwise(0.0)
    rel = F.when(F.coalesce(item["topic_key"], F.lit("")) != "", F.greatest(own, F.least(F.lit(1.0), 0.5 + bonus * 0.5))).otherwise(own)
    durable = (F.lower(item["scope"]) == "user") & F.lower(item["type"]).isin("preference", "fact", "constraint")
    rel = F.when(durable, F.greatest(rel, F.lit(0.55))).otherwise(rel)
    rel = F.when(F.lower(item["status"]) == "superseded", F.greatest(F.lit(0.35), rel * 0.85)).otherwise(rel)
    or_ = lambda c, d: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(d))
    return F.struct(
        F.lit("canonical_memory").alias("kind"), (durable & (F.coalesce(item["status"], F.lit("active")) == "active")).alias("mandatory"), rel.alias("relevance"),
        or_(item["importance"], 0.8).alias("importance"), or_(item["freshness"], 0.9).alias("freshness"), or_(item["confidence"], 0.85).alias("confidence"),
        or_(item["stability"], 0.8).alias("stability"), or_(item["information_gain"], 0.75).alias("gain"),
    )


def memory_tokens(kind: Column, content: Column) -> Column:
    return tokens(F.concat(kind, F.lit(": "), content)) + 2


def stability_label(score: Column) -> Column:
    return F.when(score >= 0.95, "permanent").when(score >= 0.7, "long-term").when(score >= 0.4, "short-term").otherwise("session")


def stability_score(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in L.STABILITY_SCORES.items() for x in kv]), label), F.lit(0.85))


def clamp01(c: Column, fallback: float) -> Column:
    number = F.coalesce(F.nanvl(c.cast("double"), F.lit(fallback)), F.lit(fallback))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))


def blended(confidence: Column, importance: Column, gain: Column, local: dict[str, Column]) -> Column:
    """A model's scores blended with the local ones: struct(confidence, importance, gain)."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence * F.greatest(F.lit(0.85), local["confidence"])))
    return F.struct(c.alias("confidence"), F.greatest(importance, local["importance"]).alias("importance"), F.greatest(gain, local["gain"]).alias("gain"))
