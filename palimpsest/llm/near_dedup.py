"""MinHash near-dedup: fast similarity sketches, banding, and exact verification on full shingle sets.

1. Every text becomes its set of distinct n-word shingles (64-bit hashes). Rows with equal sets form one class,
   represented by its smallest id; only classes go on.
2. A class's sketch of 200 coordinates gives 40 band keys of 5 coordinates. Two sets of similarity 0.8 share
   no band with probability (1 - 0.8^5)^40 = 1.3e-7, less above.
3. Each bucket (equal band key) is led by its densest member, the one whose buckets are fullest. A leader's group is
   all members of the buckets that it leads, so any two classes that share a bucket share a group, and a family
   of near copies, which shares dozens of buckets, is mostly one group. Groups are of linear size in all.
4. Every member is compared with its leader, first by sketches (at similarity 0.8 under 60 % of the coordinates agree
   with a probability under 1e-9), then on full sets: linear in the members, a large group in many parts.
   Members with linked leaders in common have one home.
5. Members that their leader is not connected with must still meet the rest of their group. Sketches again tell which
   of them have a partner in another home; their whole texts are compared in pairs of blocks, in which
   the members connected with the leader meet only those that are not. So nothing but what no leader explains is
   compared pair by pair; only links that connect something new are returned.
6. Every member stands for its home, which it is connected with, so components are those of the links between homes,
   of which a family that few leaders explain has few.

Defined results: a null or wordless text has no set and links with nothing (component: its own id). Rows with
a null id link with nothing; their component is null. Repeated rows all come back with the same component.
Rows that share an id but not a text are linked each by its own set; nothing links them through their id.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.llm.base import cut, per_batch, table
from palimpsest.llm.components import components
from palimpsest.llm.sketch import bands, bytes_of, sketches
from palimpsest.llm.text import Buffer, mix, pieces, shingle_sets

U64 = np.uint64
COORDINATES, BAND_ROWS = 200, 5
#: Least share of agreeing coordinates of a pair that is verified.
AGREE = 0.6
#: Members, and shingles, of a group that one task compares with as many others; larger groups are cut into blocks.
BLOCK, BLOCK_SHINGLES = 4096, 1_500_000
#: Rows of two numbers that are broadcast at most; more are joined by key.
FEW = 1 << 18


def _sets(texts: list, ngram: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, z in pieces(texts):
        b = Buffer(texts[a:z])
        start, end, doc = b.spans()
        yield a, z, *shingle_sets(b.hashes(start, end), doc, z - a, ngram)


def _names(elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set: two sums of mixed elements (0, 0 for the empty set)."""
    out = []
    for salt in (0x1F83D9AB, 0x5BE0CD19):
        c = np.concatenate([np.zeros(1, U64), np.cumsum(mix(elements ^ U64(salt)), dtype=U64)])
        out.append((c[offsets[1:]] - c[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_a, set_b, bands, sketch) of whole texts; bands and sketch are null for empty sets."""

    def sign(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_shingles", "set_a", "set_b", "bands", "sketch")}
        for _, _, e, off in _sets(batch["text"], ngram):
            s = sketches(e, off, COORDINATES)
            some = np.diff(off) > 0
            out["n_shingles"] += np.diff(off).tolist()
            for k, v in zip(("set_a", "set_b"), _names(e, off), strict=True):
                out[k] += v.tolist()
            out["bands"] += [x if y else None for x, y in zip(bands(s, BAND_ROWS), some, strict=True)]
            out["sketch"] += [x.tobytes() if y else None for x, y in zip(bytes_of(s), some, strict=True)]
        return {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], **out}

    return per_batch(docs, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary", sign)


def _sized(rows: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """`rows` with what `sizes` has for their `by`: nothing to join if it is empty, a broadcast while it is small, else a join."""
    few = cut(sizes)
    n = few.count()
    if not n:
        return rows.withColumns({c: F.lit(None).cast("int") for c in few.columns if c != by})
    return rows.join(F.broadcast(few) if n <= FEW else few, by, "left")


def _beside_leaders(members: DataFrame) -> DataFrame:
    """`members` (leader, class, ..) dealt by leader, large groups in parts; each part begins with the leader's row."""
    parts = members.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__k")).where("__k > 1")
    rows = _sized(members, parts, "leader").withColumn("__k", F.coalesce("__k", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("class"), F.col("__k")).cast("int"))
    parts = F.when(F.col("class") == F.col("leader"), F.sequence(F.lit(0), F.col("__k") - 1)).otherwise(own)
    rows = rows.withColumn("part", F.explode(parts)).drop("__k").withColumn("member", F.col("class") != F.col("leader"))
    return rows.repartition("leader", "part").sortWithinPartitions("leader", "part", "member")


def _arrow(frame: DataFrame, schema: str, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]]) -> DataFrame:
    """mapInArrow whose function yields columns as lists."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in f(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return frame.mapInArrow(run, schema)


def near_leaders(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(leader, class) of the members of `groups` (leader, class) whose sketch agrees with their leader's."""

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        led = np.zeros(COORDINATES, np.uint8)
        for b in batches:
            if not b.num_rows:
                continue
            sk = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, COORDINATES)
            sk = np.concatenate([led[None], sk])  # row 0: the leader that the rows before the first one here have
            member = np.concatenate([[False], b.column(2).to_numpy(zero_copy_only=False)])
            at = np.maximum.accumulate(np.where(member, 0, np.arange(len(sk))))
            near = np.flatnonzero(member & ((sk == sk[at]).mean(1) >= AGREE)) - 1
            led = sk[at[-1]].copy()
            yield {"leader": b.column(0).take(near).to_pylist(), "class": b.column(1).take(near).to_pylist()}

    met = _beside_leaders(groups.join(classes.select("class", "sketch"), "class"))
    return _arrow(met.select("leader", "class", "member", "sketch"), "leader long, class long", agreeing)


def _texts(rows: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """`rows` (class, ..) with the whole text of each class, that of its representative."""
    wanted = classes.join(rows.select("class").distinct(), "class", "left_semi").select("class", F.col("rep").alias("doc_id"), "text_hash")
    if (few := cut(wanted)).count() <= FEW:  # texts that nobody asks for need not be dealt
        docs = docs.join(F.broadcast(few.select("doc_id", "text_hash")), ["doc_id", "text_hash"], "left_semi")
    return rows.join(docs.join(few, ["doc_id", "text_hash"]).select("class", "text"), "class")


def links_with_leaders(near: DataFrame, classes: DataFrame, docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """(a, b): the members of `near` (leader, class) whose full set is similar to their leader's."""
    both = near.unionByName(near.select("leader", F.col("leader").alias("class")).distinct())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        led = np.zeros(0, U64)
        for b in batches:
            leader, cls, member = (b.column(i).to_pylist() for i in range(3))
            out: dict[str, list] = {"a": [], "b": []}
            for lo, _, e, off in _sets(b.column(3).to_pylist(), ngram):
                for i in range(len(off) - 1):
                    own = e[off[i] : off[i + 1]]
                    if not member[lo + i]:
                        led = own.copy()
                        continue
                    # both are sorted
                    spot = np.minimum(np.searchsorted(led, own), len(led) - 1)
                    inter = int((led[spot] == own).sum())
                    if 100 * inter >= percent * (len(own) + len(led) - inter):
                        out["a"].append(leader[lo + i])
                        out["b"].append(cls[lo + i])
            yield out

    met = _beside_leaders(_texts(both, classes, docs))
    return _arrow(met.select("leader", "class", "member", "text"), "a long, b long", check)


def _blocks(members: DataFrame, size: Column, most: int) -> DataFrame:
    """`members` (leader, class, home, main, ..) once for each pair of blocks that has work for theirs.

    `main` members, which the group's leader is already connected with, need only meet the others; so a group's others
    are cut into blocks of `most` of `size` in all, its main members too, and every block of others meets all blocks.
    """
    of = lambda which: F.ceil(F.sum(F.when(which, size)) / most).cast("int")
    counts = members.groupBy("leader").agg(of(~F.col("main")).alias("__u"), F.coalesce(of(F.col("main")), F.lit(0)).alias("__m"))
    rows = _sized(members, counts.where("__u > 1 or __m > 1"), "leader").withColumns({"__u": F.coalesce("__u", F.lit(1)), "__m": F.coalesce("__m", F.lit(1))})
    mine = F.pmod(F.xxhash64("class"), F.when(F.col("main"), F.col("__m")).otherwise(F.col("__u"))).cast("int")
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda x: x < n)
    block = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    # others' blocks are 0, 1, ..; main blocks -1, -2, ..
    with_others = F.transform(upto(F.col("__u")), lambda j: block(F.least(mine, j), F.greatest(mine, j)))
    with_main = F.transform(upto(F.col("__m")), lambda j: block(-1 - j, mine))
    to_others = F.transform(upto(F.col("__u")), lambda i: block(-1 - mine, i))
    rows = rows.withColumn("__b", F.explode(F.when(F.col("main"), to_others).otherwise(F.concat(with_others, with_main))))
    rows = rows.select("*", "__b.lo", "__b.hi").drop("__b", "__u", "__m")
    return rows.repartition("leader", "lo", "hi").sortWithinPartitions("leader", "lo", "hi")


def _by_group(batches: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[tuple[list, dict[str, list]]]:
    """(key, columns) of runs of rows whose first columns are alike, in frames sorted by them; a run may end with its batch."""
    for b in batches:
        d = b.to_pydict()
        names = list(d)
        every = list(zip(*(d[n] for n in names[:keys]), strict=True))
        a = 0
        while a < len(every):
            z = a + 1
            while z < len(every) and every[z] == every[a]:
                z += 1
            yield list(every[a]), {n: d[n][a:z] for n in names}
            a = z


def promising(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Of `members` (leader, class, home, main), those whose sketch agrees with one of the group in another home."""

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        at, held = None, {}

        def done() -> dict[str, list]:
            sk = np.frombuffer(b"".join(held["sketch"]), np.uint8).reshape(-1, COORDINATES)
            home, main = np.array(held["home"]), np.array(held["main"])
            stay = np.zeros(len(sk), bool)
            for i in np.flatnonzero(~main).tolist():
                same = (home != home[i]) & ((sk == sk[i]).mean(1) >= AGREE)
                if same.any():
                    stay |= same
                    stay[i] = True
            pick = np.flatnonzero(stay).tolist()
            return {k: [v[i] for i in pick] for k, v in held.items() if k not in ("sketch", "lo", "hi")}

        for key, part in _by_group(batches):
            if key != at:
                if at is not None:
                    yield done()
                at, held = key, {k: [] for k in part}
            for k, v in part.items():
                held[k] += v
        if at is not None:
            yield done()

    met = _blocks(members.join(classes.select("class", "sketch"), "class"), F.lit(1), BLOCK)
    return _arrow(met.select("leader", "lo", "hi", "class", "home", "main", "sketch"), "leader long, class long, home long, main boolean", agreeing).distinct()


def connecting(sets: list[np.ndarray], percent: int, homes: list | None = None, asking: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links (100 * |intersection| >= percent * |union|) that connect the same sets as all links do, and no more of them.

    Sets of equal `homes` are already connected; only sets that are `asking` are compared with all others, each at once,
    by a mark on its elements.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)])
    home = np.arange(n) if homes is None else np.unique(homes, return_inverse=True)[1]
    mark = np.zeros(int(ids.max()) + 1, bool)
    out = []
    for i in np.argsort(-size, kind="stable").tolist():
        if (home == home[i]).all():
            break
        if asking is not None and not asking[i]:
            continue
        own = ids[first[i] : first[i + 1]]
        mark[own] = True
        inter = np.add.reduceat(mark[ids], first[:-1], dtype=np.int64)
        mark[own] = False
        for j in np.flatnonzero((home != home[i]) & (100 * inter >= percent * (size + size[i] - inter))).tolist():
            if home[j] != home[i]:
                out.append((i, j))
                home[home == home[j]] = home[i]
    return out


def links_of_the_rest(members: DataFrame, classes: DataFrame, docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """(a, b): the homes that links within the groups of `members` (leader, class, home, main) connect, on full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        at, sets, held = None, [], {}

        def done() -> dict[str, list]:
            links = connecting(sets, percent, held["home"], [not x for x in held["main"]])
            return {"a": [held["home"][i] for i, _ in links], "b": [held["home"][j] for _, j in links]}

        for key, part in _by_group(batches):
            if key != at:
                if len(sets) > 1:
                    yield done()
                at, sets, held = key, [], {k: [] for k in ("home", "main")}
            for _, _, e, off in _sets(part["text"], ngram):
                sets += [e[off[i] : off[i + 1]].copy() for i in range(len(off) - 1)]
            for k in held:
                held[k] += part[k]
        if len(sets) > 1:
            yield done()

    sized = members.join(classes.select("class", "n_shingles"), "class")
    met = _blocks(_texts(sized, classes, docs), F.col("n_shingles"), BLOCK_SHINGLES)
    return _arrow(met.select("leader", "lo", "hi", "class", "home", "main", "text"), "a long, b long", check)


def near_dedup(docs: DataFrame, ngram: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, component) for every row of `docs` (doc_id, text).

    kept: the row's id names its component. `component` tells components apart where they share an id; null without a set.
    """
    docs = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    signed = cut(signatures(docs, ngram))
    some = signed.where("doc_id is not null and n_shingles > 0")
    best = F.min(F.struct("doc_id", "text_hash", "n_shingles", "bands", "sketch")).alias("x")
    named = some.groupBy("set_a", "set_b").agg(best).select("set_a", "set_b", F.col("x.doc_id").alias("rep"), "x.text_hash", "x.n_shingles", "x.bands", "x.sketch")
    classes = cut(named.withColumn("class", F.monotonically_increasing_id()))
    banded = classes.select("class", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(banded.join(shared, "key"))
    weight = members.groupBy("class").agg(F.sum("n").alias("weight"))
    led = members.join(weight, "class").groupBy("key").agg(F.max(F.struct("weight", (-F.col("class")).alias("minus"))).alias("top"))
    groups = cut(members.join(led, "key").select((-F.col("top.minus")).alias("leader"), "class").distinct())

    near = cut(near_leaders(groups, classes))
    links = cut(links_with_leaders(near, classes, docs, ngram, percent))
    # a member's home: the smallest leader that it is linked with, and that one's own; more of a family need not meet again
    ends = links.select(F.col("b").alias("class"), F.col("a").alias("home")).unionByName(links.select(F.col("a").alias("class"), F.col("a").alias("home")))
    first = cut(ends.groupBy("class").agg(F.min("home").alias("home")))
    home = cut(first.join(first.select(F.col("class").alias("home"), F.col("home").alias("on")), "home", "left").select("class", F.coalesce("on", "home").alias("home")))
    placed = groups.join(home, "class", "left").withColumn("home", F.coalesce("home", "class"))
    of_leader = home.select(F.col("class").alias("leader"), F.col("home").alias("leader_home"))
    placed = placed.join(of_leader, "leader", "left").withColumn("leader_home", F.coalesce("leader_home", "leader"))
    placed = cut(placed.withColumn("main", F.col("home") == F.col("leader_home")))
    # groups in which the leader does not explain everything
    still = placed.drop("leader_home").join(placed.where("not main").select("leader").distinct(), "leader", "left_semi")
    rest = cut(promising(still, classes))
    # links within a home connect nothing; those between a member's home and its leader's go on
    apart = placed.where("not main").join(links.select(F.col("a").alias("leader"), F.col("b").alias("class")), ["leader", "class"], "left_semi")
    apart = apart.select(F.col("leader_home").alias("a"), F.col("home").alias("b"))
    found = components(apart.unionByName(links_of_the_rest(rest, classes, docs, ngram, percent)))

    named = classes.select("class", "set_a", "set_b", "rep").join(home, "class", "left").withColumn("home", F.coalesce("home", "class"))
    found = named.join(found, named["home"] == found["node"], "left").select("set_a", "set_b", "rep", F.coalesce("component", "home").alias("component"))
    least = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    done = some.join(found.join(least, "component").drop("rep"), ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id", "text_hash", "component")
    none = F.lit(None).cast("long")
    alone = signed.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", none.alias("component"))
    return done.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "component")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), ngram=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")
