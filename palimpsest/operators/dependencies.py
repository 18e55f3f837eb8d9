"""The memory's fold without one group a user: candidates that can't touch one another are folded apart.

What a candidate does depends on items of its type with its topic or nearly its text, on what a correction names, and on
nothing else of its user. Candidates and active items joined by these dependencies form components, found by joins and
connected components; each is a group of the fold. A revocation writes no text, so it goes to every component that holds
something it may revoke, instead of tying them together. Three things are counted over the whole user afterwards, as
prefix sums over ranges of places: ids of new items, and whether an item of its type was there when one was written; and
one is looked up in blocks of texts: whether an item of another component was 0.75 alike, which the information gain
tells. The result equals `fold.fold` row by row.

Topics and equal texts are joined through a node each, so their links are as many as the candidates. One topic with very many
candidates is one component: there each one depends on the one before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import qgrams
from palimpsest.functions.qgrams import normal_texts, similar_texts
from palimpsest.functions.scoring import WHITE, lcs_length
from palimpsest.operators import fold
from palimpsest.sources.schemas import ITEM
from palimpsest.sources.tables import stored

#: At these similarities texts merge, a correction finds its target, and information counts as partly known.
MERGES, NAMED, KNOWN = 0.9, 0.75, 0.75
#: Ids of new items while components are folded apart: this and the candidate's place.
APART = -(1 << 63)
#: Places of a range of prefix sums; texts of a block.
RANGE_BITS, BLOCK = 12, 1024


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes that `links` (a, b: longs) name; component is the least node that is reachable.

    Stars turn in rounds (large, then small) until no link changes; a round's links are no more than those before it.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    check = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = stored(small.unionByName(low.select("a", F.col("least").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == check:
            break
        check = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def before(df: DataFrame, by: list[str], pos: str, value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the group that stand at a smaller `pos` (a long from 0 on).

    Rows are dealt by ranges of `pos`, so a group is many tasks; what the earlier ranges hold comes from their totals.
    """
    df = df.withColumns({"__range": F.shiftright(pos, RANGE_BITS), "__value": value})
    sums = df.groupBy(*by, "__range").agg(F.sum("__value").alias("__sum"))
    earlier = F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "__range", earlier.alias("__earlier"))
    own = F.coalesce(F.sum("__value").over(Window.partitionBy(*by, "__range").orderBy(pos).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__own", own).join(sums, [*by, "__range"]).withColumn(out, F.col("__earlier") + F.col("__own")).drop("__range", "__value", "__own", "__earlier")


def numbered(candidates: DataFrame, order: list[str]) -> DataFrame:
    """Adds `seq`: 1, 2, .. by user in `order`, numbered within ranges of it, so that a user is many tasks."""
    ranges = stored(candidates.repartitionByRange("user_id", *order).withColumn("__part", F.spark_partition_id()))
    sums = ranges.groupBy(F.col("user_id").alias("__u"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy("__u").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("user_id", "__part").orderBy(*order))
    met = ranges.withColumn("__own", own).join(sums.select("__u", "__p", earlier.alias("__earlier")), F.col("user_id").eqNullSafe(F.col("__u")) & (F.col("__part") == F.col("__p")))
    return met.withColumn("seq", (F.col("__earlier") + F.col("__own")).cast("long")).drop("__u", "__p", "__n", "__own", "__earlier", "__part")


def _node(kind: str, *of: str | Column) -> Column:
    return F.xxhash64(F.lit(kind), *of)


def _containing(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(ask, id): texts of the user that hold an asked string. `asked`: user_id, ask, wanted; `texts`: user_id, id, low.

    A string is looked up by one of its grams of three characters (of all, if it is shorter), and then tested.
    """
    size = F.least(F.length("wanted"), F.lit(3))
    asked = asked.where("wanted <> ''").withColumn("gram", F.substr("wanted", F.greatest(F.lit(1), F.floor((F.length("wanted") - size) / 2).cast("int") + 1), size))
    users = asked.select("user_id").distinct()
    each = lambda q: F.transform(F.sequence(F.lit(1), F.length("low") - q + 1), lambda i: F.substr("low", i, F.lit(q)))
    every = F.flatten(F.array(*[F.when(F.length("low") >= q, each(q)).otherwise(F.array().cast("array<string>")) for q in (1, 2, 3)]))
    held = texts.join(users, "user_id", "left_semi").select("user_id", "id", "low", F.explode(F.array_distinct(every)).alias("gram"))
    held = held.join(asked.select("user_id", "gram").distinct(), ["user_id", "gram"], "left_semi")
    return held.join(asked, ["user_id", "gram"]).where(F.contains("low", "wanted")).select("ask", "id").distinct()


def _lower(rows: DataFrame, text: str, out: str) -> DataFrame:
    """`rows` with `out`: the text in lower case by Python's rules, not trimmed."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([(x or "").lower() for x in b.column(at).to_pylist()], pa.string())], names=[*b.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def dealt(ready: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, active items), each with the `component` it is folded in; a revocation has a row for each that it may touch."""
    told = ready.select("user_id", "seq", "type", "topic_key", "content", F.lit(None).cast("long").alias("id"), "old_value", "revoked_target", "revoked_value")
    known = items.select("user_id", F.lit(None).cast("long").alias("seq"), "type", "topic_key", "content", "id", *[F.lit(None).cast("string").alias(c) for c in ("old_value", "revoked_target", "revoked_value")])
    rows = told.unionByName(known)
    own = F.when(F.col("id").isNull(), _node("c", "user_id", "seq")).otherwise(_node("i", "user_id", "id"))
    rows = normal_texts(rows.withColumn("node", own), "content", "norm")
    rows = stored(_lower(rows, "content", "low"))
    writes = rows.where("revoked_target is null")
    topic = F.trim(F.coalesce("topic_key", F.lit("")), F.lit(WHITE))
    writes = writes.withColumns({"text_node": _node("t", "user_id", "type", "norm"), "topic_node": F.when(topic != "", _node("p", "user_id", "type", topic))})
    links = writes.select(F.col("node").alias("a"), F.col("text_node").alias("b")).unionByName(writes.where("topic_node is not null").select(F.col("node").alias("a"), F.col("topic_node").alias("b")))

    # texts nearly alike; those of one topic are joined already
    texts = writes.groupBy(F.col("text_node").alias("id"), "user_id", "type", "norm").agg(F.coalesce(F.min("topic_node"), F.first("text_node")).cast("string").alias("home"))
    links = links.unionByName(similar_texts(texts, ["user_id", "type"], MERGES).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))

    # what corrections may name, of any type
    fixes = writes.where("id is null and old_value is not null").select("user_id", F.col("node").alias("ask"), "old_value")
    fixes = stored(normal_texts(fixes, "old_value", "wanted").where("wanted <> ''"))
    if not fixes.isEmpty():
        lows = writes.select("user_id", F.col("text_node").alias("id"), "low").dropDuplicates(["user_id", "id", "low"])
        links = links.unionByName(_containing(fixes, lows).select(F.col("ask").alias("a"), F.col("id").alias("b")))
        asks = fixes.select(F.col("ask").alias("id"), "user_id", F.col("wanted").alias("norm"))
        there = texts.join(fixes.select("user_id").distinct(), "user_id", "left_semi").select("id", "user_id", "norm")
        # an equal text has the old value within it, so only unequal ones are left to find
        links = links.unionByName(similar_texts(asks, ["user_id"], NAMED, there).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    homes = stored(components(links))
    placed = writes.join(homes, "node").select("user_id", "seq", "id", "component", "low", "topic_key")

    gone = rows.where("revoked_target is not null").select("user_id", "seq", "revoked_target", "revoked_value")
    gone = stored(_lower(normal_texts(gone, "revoked_value", "wanted"), "revoked_target", "target"))
    if gone.isEmpty():
        copies = gone.select("user_id", "seq", F.lit(None).cast("long").alias("component"))
    else:
        words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), 1))
        held = placed.join(gone.select("user_id").distinct(), "user_id", "left_semi")
        said = held.select("user_id", "component", F.explode(F.array_union(words(F.col("low")), words(F.lower(F.coalesce("topic_key", F.lit("")))))).alias("word")).distinct()
        hit = gone.select("user_id", "seq", F.explode(words(F.col("target"))).alias("word")).join(said, ["user_id", "word"]).select("user_id", "seq", "component")
        asked = gone.select("user_id", F.struct("user_id", "seq").alias("ask"), "wanted")
        within = _containing(asked, held.select("user_id", F.col("component").alias("id"), "low").distinct()).select("ask.*", F.col("id").alias("component"))
        hit = hit.unionByName(within).distinct()
        # one that touches nothing is skipped in a component of its own
        copies = gone.select("user_id", "seq").join(hit, ["user_id", "seq"], "left").withColumn("component", F.coalesce("component", _node("r", "user_id", "seq")))
    where = placed.where("seq is not null").select("user_id", "seq", "component").unionByName(copies.select("user_id", "seq", "component"))
    return ready.join(where, ["user_id", "seq"]), items.join(placed.where("id is not null").select("user_id", "id", "component"), ["user_id", "id"])


def _counts(texts: list[str]) -> np.ndarray:
    """Pairs of neighbouring characters of each text, counted in 512 buckets."""
    out = np.zeros((len(texts), 512), np.float32)
    for i, x in enumerate(texts):
        for a, b in zip(x, x[1:], strict=False):
            out[i, (ord(a) * 31 + ord(b)) % 512] += 1
    return out


def partly_known(asked: DataFrame, there: DataFrame) -> DataFrame:
    """(user_id, seq): the rows of `asked` (user_id, type, seq, norm) for which a row of `there` (user_id, type, norm, start, stop) with
    start < seq <= stop is KNOWN alike. Blocks of one band of lengths are held, the rows asked for pass by.
    """
    step = math.log((2 - KNOWN) / KNOWN)
    band = F.floor(F.log(F.greatest(F.length("norm"), F.lit(1))) / step).cast("int")
    keys = ["user_id", "type", "band"]
    there = there.withColumn("band", band)
    cuts = there.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = there.join(cuts, keys).withColumn("block", F.pmod(F.xxhash64("norm", "start"), F.col("blocks")).cast("int")).drop("blocks")
    # lengths that can be alike lie in the same band or the next
    near = asked.withColumn("band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: band + d)))
    near = near.join(cuts, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    order = [*keys, "block"]
    both = rows.select(*order, F.lit(0).alias("kind"), "norm", "start", "stop").unionByName(near.select(*order, F.lit(1).alias("kind"), "norm", F.col("seq").alias("start"), F.lit(0).cast("long").alias("stop")))
    both = both.repartition(*order).sortWithinPartitions(*order, "kind")

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, counts, spans = None, [], None, None
        for whole in batches:
            out: list[tuple] = []
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
                first = 0
                while first < len(rows):
                    end = first
                    while end < len(rows) and rows[end][:5] == rows[first][:5]:
                        end += 1
                    key, kind, part = rows[first][:4], rows[first][4], rows[first:end]
                    first = end
                    if key != at:
                        at, held, counts = key, [], None
                    if kind == 0:
                        held += [r[5:] for r in part]
                        continue
                    if not held:
                        continue
                    if counts is None:
                        counts, size = _counts([r[0] for r in held]), np.array([len(r[0]) for r in held])
                        spans = np.array([[r[1], r[2]] for r in held])
                    asked = _counts([r[5] for r in part])
                    shared = asked @ counts.T  # not less than the pairs in common
                    for i, r in enumerate(part):
                        m = len(r[5])
                        may = (spans[:, 0] < r[6]) & (r[6] <= spans[:, 1]) & (np.minimum(size, m) * 2 >= KNOWN * (size + m) - 1e-9)
                        may &= shared[i] >= qgrams.common_grams(m, size, KNOWN, 2) - 1e-6
                        where = np.flatnonzero(may)
                        for j in where[np.argsort(-shared[i][where], kind="stable")].tolist():
                            x = held[j][0]
                            if x == r[5] or (x and r[5] and 2.0 * lcs_length(r[5], x) / (m + len(x)) >= KNOWN):
                                out.append((key[0], r[6]))
                                break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64()), strict=True)], names=["user_id", "seq"])

    return both.mapInArrow(pass_by, "user_id string, seq long").distinct()


def fold_apart(ready: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """The rows of `fold.fold(ready, items)`, a group for each component instead of one for each user. `seq` counts from 1."""
    kinds = dict(x.strip().split(" ", 1) for x in ITEM.split(", "))
    if items is None:
        items = ready.sparkSession.createDataFrame([], ITEM)
    items = items.select(*[F.col(n) if n in items.columns else F.lit(None).cast(k).alias(n) for n, k in kinds.items()])
    # joins by user: one without a name is a user, too
    marked = F.when(F.col("user_id").isNull(), "-").otherwise(F.concat(F.lit("+"), "user_id"))
    ready, items = stored(ready.withColumn("user_id", marked)), stored(items.withColumn("user_id", marked))
    active = items.where("status = 'active'")
    told, known = (x.toDF(*x.columns) for x in dealt(ready, active))

    rows = stored(fold.grouped(told, known, "user_id", "component", apart=APART))

    acts = rows.where("kind = 'action'")
    # a revocation did something if it did so in any component
    gone = ready.where("revoked_target is not null").select("user_id", "seq")
    split = acts.join(gone, ["user_id", "seq"], "left_semi").groupBy("user_id", "seq").agg(F.bool_or(F.col("action") == "revoke").alias("hit"))
    layout = {n: k for n, k in (x.strip().split(" ", 1) for x in fold.ROW.split(", "))}
    made = {"kind": F.lit("action"), "seq": F.col("seq"), "user_id": F.col("user_id"), "action": F.when(F.col("hit"), "revoke").otherwise("skip"), "reason": F.when(F.col("hit"), "revocation").otherwise("no_revocation_target")}
    split = split.select(*[made.get(n, F.lit(None)).cast(k).alias(n) for n, k in layout.items()])
    acts = acts.join(gone, ["user_id", "seq"], "left_anti").select(*layout).unionByName(split)

    # ids of new items: after the user's greatest, in the order of the candidates that wrote them
    new = acts.where("action in ('create', 'supersede')").select("user_id", "seq")
    top = items.groupBy("user_id").agg(F.max("id").alias("top"))
    ids = before(new, ["user_id"], "seq", F.lit(1), "n").join(top, "user_id", "left")
    ids = stored(ids.select("user_id", (F.col("seq") + APART).alias("was"), (F.coalesce("top", F.lit(0)) + 1 + F.col("n")).alias("now")))

    def renamed(df: DataFrame, column: str) -> DataFrame:
        other = ids.select(F.col("user_id").alias("__u"), F.col("was").alias("__was"), F.col("now").alias("__now"))
        df = df.join(other, (F.col("user_id") == F.col("__u")) & (F.col(column) == F.col("__was")), "left")
        return df.withColumn(column, F.coalesce("__now", column)).drop("__u", "__was", "__now")

    held = rows.where("kind = 'item'")
    held = held.withColumns({"__id": F.col("id"), "__over": F.col("supersedes_id")})
    held = renamed(renamed(held, "id"), "supersedes_id")
    links = lambda c: F.transform(c, lambda x: F.when(x == F.col("__over"), F.col("supersedes_id")).otherwise(x))
    held = held.withColumns({"contradicts_ids": links("contradicts_ids"), "related_ids": links("related_ids")})
    held = stored(held)

    # what is not known of an item's gain from its own component
    fresh = held.where((F.col("__id") < 0) & (F.col("__id") < APART // 2))
    open_ = fresh.where("information_gain is null").select("user_id", "type", (F.col("__id") - APART).alias("seq"), "content")
    start = F.when(F.col("__id") < APART // 2, F.col("__id") - APART).otherwise(F.lit(0))
    spans = held.select("user_id", "type", "content", start.alias("start"), F.when(F.col("status") == "active", (1 << 62)).otherwise(F.col("changed_at")).alias("stop"))
    # how many items of the type were there: those begun before, less those over before
    marks = spans.select("user_id", "type", F.col("start").alias("at"), F.lit(1).alias("step")).unionByName(spans.where(F.col("stop") < (1 << 62)).select("user_id", "type", F.col("stop").alias("at"), F.lit(-1).alias("step")))
    marks = marks.unionByName(open_.select("user_id", "type", F.col("seq").alias("at"), F.lit(0).alias("step")))
    some = before(marks, ["user_id", "type"], "at", F.col("step"), "there").where("step = 0").select("user_id", F.col("at").alias("seq"), (F.col("there") > 0).alias("some"))
    alike = partly_known(normal_texts(open_, "content", "norm").select("user_id", "type", "seq", "norm"), normal_texts(spans, "content", "norm").select("user_id", "type", "norm", "start", "stop"))
    gains = some.join(alike.withColumn("alike", F.lit(True)), ["user_id", "seq"], "left")
    gains = gains.select("user_id", (F.col("seq") + APART).alias("__id"), F.when(F.col("alike"), 0.25).when(F.col("some"), 0.8).otherwise(0.85).alias("__gain"))
    held = held.join(gains, ["user_id", "__id"], "left").withColumn("information_gain", F.coalesce("information_gain", "__gain")).select(*layout)

    rest = items.where("status is null or status <> 'active'").withColumns({"kind": F.lit("item")})
    rest = rest.select(*[(F.col(n) if n in rest.columns else F.lit(None).cast(k)).alias(n) for n, k in layout.items()])
    # users without candidates, too, keep their items as they are
    out = renamed(acts, "id").select(*layout).unionByName(held).unionByName(rest)
    return out.withColumn("user_id", F.when(F.col("user_id") != "-", F.substr("user_id", F.lit(2))))



def folded(ready: DataFrame, items: DataFrame | None = None, most: int = 2000) -> DataFrame:
    """The rows of `fold.fold(ready, items)`: users of at most `most` candidates and items as a group each, all others by components."""
    ready = stored(ready)
    counts = ready.groupBy("user_id").agg(F.count("*").alias("n"))
    if items is not None:
        items = stored(items)
        counts = counts.unionByName(items.groupBy("user_id").agg(F.count("*").alias("n"))).groupBy("user_id").agg(F.sum("n").alias("n"))
    large = stored(counts.where(F.col("n") > most).select(F.col("user_id").alias("__u")))
    if large.isEmpty():
        return fold.fold(ready, items)
    parted = lambda f, how: None if f is None else f.join(large, F.col("user_id").eqNullSafe(F.col("__u")), how)
    return fold.fold(parted(ready, "left_anti"), parted(items, "left_anti")).unionByName(fold_apart(parted(ready, "left_semi"), parted(items, "left_semi")))
