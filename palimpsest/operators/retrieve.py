"""Reading the memory: filters, search, linked items, conflict resolution and points in time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from datetime import datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.sources.tables import spread_by, stored

#: Orders that retrieval knows; ids break ties, newest first.
ORDERS = {"importance": "importance", "confidence": "confidence", "recent": "updated_at"}


def holds(columns: Sequence[str], term: str, case_sensitive: bool = True) -> Column:
    """Whether any of the columns contains the term, as it stands."""
    fit = (lambda c: F.col(c).contains(term)) if case_sensitive else (lambda c: F.lower(F.col(c)).contains(term.lower()))
    return reduce(lambda a, b: a | b, [F.coalesce(fit(c), F.lit(False)) for c in columns])


def matching(
    items: DataFrame, subject: str | None = None, predicate: str | None = None, scope: str | None = None, min_confidence: float | None = None,
    min_importance: float | None = None, min_stability: float | None = None, status: str | Sequence[str] = "active", include_historical: bool = False,
    keyword: str | None = None, keywords: Sequence[str] | None = None, recency_seconds: int | None = None, as_of: datetime | None = None, case_sensitive: bool = True,
) -> DataFrame:
    """Items that meet every condition given. Only conditions on columns, so that they reach the scan."""
    for c, v in (("subject", subject), ("predicate", predicate), ("scope", scope)):
        if v:
            items = items.where(F.col(c) == v)
    for c, v in (("confidence", min_confidence), ("importance", min_importance), ("stability", min_stability)):
        if v is not None:
            items = items.where(F.col(c) >= v)
    if not include_historical:
        items = items.where(F.col("status").isin([status] if isinstance(status, str) else list(status)))
    if keyword and keyword.strip():
        items = items.where(holds(("content", "value", "predicate"), keyword.strip(), case_sensitive))
    terms = [k.strip() for k in keywords or () if len(k.strip()) > 1]
    if terms:
        fields = ("content", "value", "predicate", "subject", "topic_key")
        items = items.where(reduce(lambda a, b: a | b, [holds(fields, t, case_sensitive) for t in terms]))
    if recency_seconds and recency_seconds > 0:
        if as_of is None:
            raise ValueError("recency needs as_of")
        items = items.where(F.col("updated_at") >= F.lit(as_of) - F.make_dt_interval(secs=F.lit(recency_seconds)))
    return items


def retrieve(items: DataFrame, order: str = "recent", limit: int | None = 20, user_id: str | None = None, **conditions) -> DataFrame:
    """The first `limit` matching items of a user, with `current`; without a user, of each."""
    order_by = [F.col(ORDERS[order]).desc(), F.col("id").desc()]
    if user_id is not None:
        found = matching(items.where(F.col("user_id") == user_id), **conditions).orderBy(*order_by)
        found = found.limit(limit) if limit is not None else found
    else:
        found = matching(items, **conditions)
        if limit is not None:
            found = found.withColumn("__n", F.row_number().over(Window.partitionBy("user_id").orderBy(*order_by))).where(F.col("__n") <= limit).drop("__n")
    return found.withColumn("current", F.col("status") == "active")


def search(items: DataFrame, query: str, user_id: str | None = None, limit: int = 20) -> DataFrame:
    """Active items that hold any of the query's first 12 terms, the most important first."""
    terms = [t for t in query.split() if len(t) > 1][:12]
    return retrieve(items, "importance", limit, user_id, keywords=terms or None)


def search_messages(messages: DataFrame, query: str, user_id: str, limit: int = 10) -> DataFrame:
    """(source, row_id, content, role, score) of a user's messages that hold the query; nothing for a blank one."""
    found = messages.where((F.col("user_id") == user_id) & F.col("content").contains(query.strip()) & F.lit(bool(query.strip())))
    return found.orderBy("ordinal").limit(limit).select(F.lit("message").alias("source"), F.col("ordinal").cast("long").alias("row_id"), "content", "role", F.lit(1.0).alias("score"))


def search_items(items: DataFrame, query: str, user_id: str, limit: int = 10) -> DataFrame:
    """The same over active items."""
    found = items.where((F.col("user_id") == user_id) & (F.col("status") == "active") & F.col("content").contains(query.strip()) & F.lit(bool(query.strip())))
    return found.orderBy("id").limit(limit).select(F.lit("memory").alias("source"), F.col("id").alias("row_id"), "content", F.col("type").alias("item_type"), "topic_key", F.lit(1.0).alias("score"))


def links(items: DataFrame) -> DataFrame:
    """(user_id, id, target): what each item supersedes, contradicts and is related to."""
    lists = [F.array(F.col("supersedes_id")), *[F.coalesce(F.col(c), F.array().cast("array<long>")) for c in ("contradicts_ids", "related_ids") if c in items.columns]]
    return items.select("user_id", "id", F.explode(F.array_distinct(F.concat(*lists))).alias("target")).where("target is not null")


def expand(seeds: DataFrame, items: DataFrame, depth: int = 1, active_only: bool = True, limit: int | None = None) -> DataFrame:
    """Items of the same user that the seeds link to, over `depth` links, without the seeds; revoked ones never.

    Only ids and links go round, each round stored; the items' other columns are read once, for what was found.
    """
    pool = items.where("status = 'active'" if active_only else "status <> 'revoked'")
    ids = ["user_id", "id"]
    seen = stored(seeds.select(*ids).distinct())
    edges = stored(links(pool)) if depth > 1 else None
    found, frontier = None, links(seeds)
    for i in range(depth):
        new = stored(frontier.select("user_id", F.col("target").alias("id")).distinct().join(seen, ids, "left_anti"))
        found, seen = (new if found is None else found.unionByName(new)), seen.unionByName(new)
        if i + 1 < depth:
            frontier = edges.join(new, ids, "left_semi")
    found = pool.join(found, ids, "left_semi") if found is not None else pool.limit(0)
    return found if limit is None else found.withColumn("__n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("id").desc()))).where(F.col("__n") <= limit).drop("__n")


#: Seeds and links of a user that one task searches; users of more are searched in rounds.
SEARCHED = 1 << 16


def _reached(first: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, id): what `first` (user_id, id) reaches over `edges` (user_id, id, target), without `first`; a user of more than SEARCHED rows gives one null."""
    rows = first.select("user_id", F.lit(0).alias("kind"), "id", F.lit(None).cast("long").alias("target")).unionByName(edges.select("user_id", F.lit(1).alias("kind"), "id", "target"))
    rows = spread_by(rows.where("user_id is not null"), "user_id").sortWithinPartitions("user_id", "kind")

    def search(start: set, to: dict[int, list[int]], n: int) -> Iterable[int | None]:
        if n > SEARCHED:
            return [None]
        seen, todo = set(start), list(start)
        while todo:
            new = set(to.get(todo.pop(), ())) - seen
            seen |= new
            todo += new
        return seen - start

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, start, to, n, schema = None, set(), {}, 0, None
        found: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], schema.field(c).type) for i, c in enumerate(("user_id", "id"))], names=["user_id", "id"])
        for b in batches:
            schema = b.schema
            for user, kind, own, target in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if user != at:
                    found += [(at, x) for x in search(start, to, n)] if start else []
                    at, start, to, n = user, set(), {}, 0
                if kind and not start:
                    continue  # nothing to begin with
                n += 1
                if n > SEARCHED:
                    to = {}
                elif kind:
                    to.setdefault(own, []).append(target)
                else:
                    start.add(own)
            if found:
                yield batch()
                found = []
        if start:
            found = [(at, x) for x in search(start, to, n)]
            yield batch()

    return rows.mapInArrow(pass_by, T.StructType([rows.schema["user_id"], rows.schema["id"]]))


def expand_all(seeds: DataFrame, items: DataFrame, active_only: bool = True) -> DataFrame:
    """Items of the same user that the seeds link to over any number of links, without the seeds; revoked ones never.

    A user's links are searched as they pass by. Users of more than SEARCHED links are searched in rounds, each of which meets only
    what the round before found anew, so cycles end it. A recursive query would do the same in one plan, but can only add
    rows, not leave out what is known: where links meet again, its paths would multiply.
    """
    pool = items.where("status = 'active'" if active_only else "status <> 'revoked'")
    edges = links(items).join(pool.select("user_id", F.col("id").alias("target")), ["user_id", "target"]).select("user_id", "id", "target")
    first = seeds.select("user_id", "id").distinct()
    found = stored(_reached(first, edges))
    reached, large = found.where("id is not null"), found.where("id is null").select("user_id")
    if not large.isEmpty():
        edges = stored(edges.join(large, "user_id", "left_semi"))
        first = stored(first.join(large, "user_id", "left_semi"))
        seen = frontier = first
        while not frontier.isEmpty():
            frontier = stored(frontier.join(edges, ["user_id", "id"]).select("user_id", F.col("target").alias("id")).distinct().join(seen, ["user_id", "id"], "left_anti"))
            seen = stored(seen.unionByName(frontier))
        reached = reached.unionByName(seen.join(first, ["user_id", "id"], "left_anti"))
    return pool.join(reached, ["user_id", "id"], "left_semi")


def conflict_rank() -> Column:
    """1 for the item in force of each user's topic: of the highest version, then latest, then active, then highest id; blank topics are all alone."""
    topic = F.trim(F.coalesce("topic_key", F.lit("")))
    alone = F.when(topic == "", F.col("id"))
    w = Window.partitionBy("user_id", topic, alone).orderBy(F.col("version").desc(), F.col("updated_at").desc(), (F.col("status") == "active").desc(), F.col("id").desc())
    return F.row_number().over(w)


def resolve_conflicts(items: DataFrame) -> DataFrame:
    """The items in force: one of each user's topic, by `conflict_rank`."""
    return items.withColumn("__n", conflict_rank()).where("__n = 1").drop("__n")


def version_chain(items: DataFrame) -> DataFrame:
    """Versions, supersession and validity of single-valued topics from their writes alone: user_id, topic_key, id, valid_from in."""
    w = Window.partitionBy("user_id", "topic_key").orderBy("valid_from", "id")
    return items.withColumns({
        "version": F.row_number().over(w), "supersedes_id": F.lag("id").over(w), "valid_until": F.lead("valid_from").over(w),
        "status": F.when(F.lead("id").over(w).isNull(), "active").otherwise("superseded"),
    })


def as_of(items: DataFrame, moment: datetime) -> DataFrame:
    """Items valid at a moment."""
    t = F.lit(moment)
    return items.where((F.col("valid_from") <= t) & (F.col("valid_until").isNull() | (t < F.col("valid_until"))))


def union_by_id(*frames: DataFrame) -> DataFrame:
    """The frames' items by user and id, the earlier frame's first."""
    marked = [f.withColumn("__from", F.lit(k)) for k, f in enumerate(frames)]
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    w = Window.partitionBy("user_id", "id").orderBy("__from")
    return all_.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__from")


def forget_targets(items: DataFrame, id: int | None = None, topic: str | None = None, attribute: str | None = None, content: str | None = None) -> DataFrame:
    """Active items to forget; the first condition given decides."""
    active = items.where("status = 'active'")
    if id is not None:
        return active.where(F.col("id") == id)
    if topic:
        return active.where(F.lower("topic_key") == topic.strip().lower())
    if attribute:
        return active.where(F.lower("predicate") == attribute.strip().lower())
    return active.where(F.lower("content").contains(content.lower())) if content else active.limit(0)


def obsolete(items: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Active items that a description of the same user (user_id, description) names: by id, or text within text either way."""
    d = descriptions.select("user_id", F.lower(F.trim("description")).alias("__d")).where("__d <> ''").distinct()
    own, topic = F.lower("content"), F.lower(F.coalesce("topic_key", F.lit("")))
    named = F.when(F.col("__d").rlike("^[0-9]+$"), F.col("id").cast("string") == F.col("__d")).otherwise(F.contains("__d", own) | F.contains(own, F.col("__d")) | ((topic != "") & F.contains(F.col("__d"), topic)))
    hits = items.where("status = 'active'").join(d, "user_id").where(named).select("user_id", "id").distinct()
    return items.join(hits, ["user_id", "id"], "left_semi")


def revoked_by(items: DataFrame, revocations: DataFrame) -> DataFrame:
    """Active items that a revocation of the same user (user_id, target, value) hits: the value within, or a word in common."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    r = revocations.select("user_id", F.lower(F.trim("value")).alias("__v"), words(F.col("target")).alias("__t"))
    hit = ((F.col("__v") != "") & F.contains(F.lower("content"), F.col("__v"))) | F.arrays_overlap("__t", F.concat(words(F.col("content")), words(F.coalesce("topic_key", F.lit("")))))
    hits = items.where("status = 'active'").join(r, "user_id").where(hit).select("user_id", "id").distinct()
    return items.join(hits, ["user_id", "id"], "left_semi")
