"""Exact similarity joins for LCS ratios: an inverted index of q-grams with length bands, then verification by bits.

Of two texts of m and n characters that are at least t alike, at most (1 - t)(m + n) characters are outside their longest
common subsequence. A character left out of one text breaks at most q of its q-grams, one put into the other at most q - 1,
so the texts share at least ((2q - 1) t / 2 - (q - 1)) (m + n) - (q - 1) of their q-grams, counted with repeats. Texts in a
fixed order of their grams, rare ones first, must therefore share one among their first grams, and only these are indexed.
Where the bound is not positive (short texts) single characters are indexed in the same way. What the index brings
together is met once, tested against lengths and the count of common grams, and only then compared.

In a group whose texts have most grams in common the index would bring each pair together many times. Such a group is cut into
blocks instead, and each pair of blocks is compared at once, by words of 64 bits; all other groups go by the index.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.scoring import lcs_length
from palimpsest.sources.tables import spread_by, stored

#: Buckets of the table of gram frequencies: its size is fixed, and a shared bucket only makes a gram look more frequent.
BUCKETS = 1 << 16
_MASK = (1 << 64) - 1
#: Rows that are broadcast at most; the layout of a pair.
FEW, PAIR = 1 << 16, "id_a long, id_b long, similarity double"
#: Texts of a block, and words of 64 bits that marks of their characters take at most.
BLOCK, MARKS = 1024, 1 << 22


def gram_size(least: float) -> int:
    """The longest q-grams, of three at most, whose bound is worth having at this similarity."""
    return next(q for q in (3, 2, 1) if (2 * q - 1) * least / 2 - (q - 1) > 0.1)


def common_grams(m: int, n: int | np.ndarray, least: float, q: int) -> float | np.ndarray:
    """At least so many q-grams, with repeats, are common to texts of m and n characters that are `least` alike."""
    return ((2 * q - 1) * least / 2 - (q - 1)) * (m + n) - (q - 1)


def may_match(m: int, n: int, least: float) -> bool:
    return min(m, n) * 2 >= least * (m + n) - 1e-9


def grams(text: str, q: int) -> Counter:
    return Counter(text[i : i + q] for i in range(len(text) - q + 1))


def hashed(gram: str) -> int:
    """A 64-bit hash that is the same in every process."""
    h = 0xCBF29CE484222325
    for b in gram.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 0x100000001B3 & _MASK
    h ^= h >> 32
    return h


def short(m: int, least: float, q: int) -> bool:
    """Whether some partner of a text of m characters is not bound to share a q-gram with it."""
    return common_grams(m, math.ceil(m * least / (2 - least) - 1e-9), least, q) <= 1e-9


def prefix(text: str, least: float, q: int, frequency: np.ndarray) -> list[int]:
    """The tokens of a text that the index holds: of each kind (q-grams, characters) the rarest, as many as can't all be missed."""
    m, out = len(text), []
    fewest = math.ceil(m * least / (2 - least) - 1e-9)
    # the least and greatest partner decide which kinds a pair can need: characters if its shorter text is short
    kinds = [q] if q == 1 else ([] if short(m, least, q) else [q]) + ([1] if short(fewest, least, q) else [])
    for k in kinds:
        tokens = []
        for g, n in grams(text, k).items():
            h = hashed(g)
            tokens += [(int(frequency[h % BUCKETS]) if k == q else 0, (h * 31 + i * 0x9E3779B97F4A7C15 + k) & _MASK) for i in range(n)]
        tokens.sort()
        need = max(1, math.ceil(common_grams(m, fewest, least, k) - 1e-9))
        out += [h - (1 << 63) for _, h in tokens[: max(0, len(tokens) - need + 1)]]
    return out


def verified(a: str, b: str, least: float, q: int) -> float | None:
    """The similarity of two texts if it is at least `least`; the subsequence is sought only if lengths and grams allow that."""
    m, n = len(a), len(b)
    if not may_match(m, n, least) or sum((grams(a, q) & grams(b, q)).values()) < common_grams(m, n, least, q) - 1e-9:
        return None
    s = 2.0 * lcs_length(a, b) / (m + n)
    return s if s >= least else None


def block_pairs(left: list[str], right: list[str], least: float) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(i, j, similarities): the texts i of `left` that are at least `least` like text j of `right`, a row of the table for all of them at once."""
    order = sorted(range(len(left)), key=lambda i: len(left[i]))
    signs: dict[str, int] = {}
    for x in left:
        for ch in x:
            signs.setdefault(ch, len(signs))
    words = (len(left[order[-1]]) + 63) // 64 if order else 1
    step = max(16, MARKS // max(1, len(signs) * words))
    for a in range(0, len(order), step):
        part = order[a : a + step]
        m = np.array([len(left[i]) for i in part])
        marks = np.zeros((len(signs), words, len(part)), np.uint64)
        for k, i in enumerate(part):
            for at, ch in enumerate(left[i]):
                marks[signs[ch], at >> 6, k] |= np.uint64(1 << (at & 63))
        full = np.zeros((words, len(part)), np.uint64)
        for w in range(words):
            bits = np.clip(m - 64 * w, 0, 64)
            full[w] = np.where(bits == 64, np.uint64(_MASK), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
        ids = np.array(part)
        for j, y in enumerate(right):
            n = len(y)
            lo, hi = np.searchsorted(m, [n * least / (2 - least) - 1e-6, n * (2 - least) / least + 1e-6], "left")
            if lo == hi:
                continue
            row = full[:, lo:hi].copy()
            for ch in y:
                sign = signs.get(ch)
                if sign is None:
                    continue
                carry = None
                for w in range(words):
                    old = row[w]
                    hit = old & marks[sign, w, lo:hi]
                    total = old + hit
                    if words > 1:
                        over = total < hit
                        if carry is not None:
                            total += carry
                            over |= total < carry
                        carry = over.astype(np.uint64)
                    row[w] = total | (old ^ hit)
            common = m[lo:hi] - np.bitwise_count(row & full[:, lo:hi]).sum(0, dtype=np.int64)
            alike = 2.0 * common / (m[lo:hi] + n)
            at = np.flatnonzero(alike >= least)
            if len(at):
                yield ids[lo + at], j, alike[at]


def normal_texts(rows: DataFrame, text: str, out: str) -> DataFrame:
    """`rows` with `out`: the text as similarities see it, lower-cased and trimmed by Python's rules."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [None if x is None else x.lower().strip() for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low, pa.string())], names=[*b.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def _frequencies(texts: DataFrame, q: int) -> np.ndarray:
    """How many texts hold a gram of each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total[list({hashed(g) % BUCKETS for g in grams(x, q)})] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("norm").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r.bucket] = r.n
    return out


def _dense(rows: DataFrame, tokens: DataFrame, by: list[str], own: bool) -> DataFrame:
    """The groups `by` in which tokens bring texts together as often as a quarter of all pairs, with the `blocks` of each side."""
    n = lambda side: F.count(F.when(F.col("side") == side, 1))
    pairs = (F.col("a") * (F.col("a") - 1) / 2) if own else F.col("a").cast("double") * F.col("b")
    meets = tokens.groupBy(*by, "token").agg(n("a").alias("a"), n("b").alias("b")).groupBy(*by).agg(F.sum(pairs).alias("meets"))
    sizes = rows.groupBy(*by).agg(n("a").alias("a"), n("b").alias("b"))
    blocks = lambda side: F.greatest(F.ceil(F.col(side) / BLOCK), F.lit(1)).cast("int")
    return sizes.join(meets, by).where((F.col("meets") > 0) & (4 * F.col("meets") >= pairs)).select(*by, blocks("a").alias("blocks_a"), (blocks("a") if own else blocks("b")).alias("blocks_b"))


def _by_blocks(rows: DataFrame, dense: DataFrame, by: list[str], least: float, home: bool, own: bool) -> DataFrame:
    """The similar pairs of the groups in `dense`, every pair of blocks compared in one task."""
    met = rows.join(F.broadcast(dense) if dense.count() <= FEW else dense, by)
    block = F.pmod(F.xxhash64("id", "norm"), F.when(F.col("side") == "a", F.col("blocks_a")).otherwise(F.col("blocks_b"))).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    pair = lambda lo, hi, left: F.struct(lo.alias("lo"), hi.alias("hi"), left.alias("right"))
    if own:
        each = F.transform(upto("blocks_a"), lambda j: pair(F.least(block, j), F.greatest(block, j), block > j))
    else:
        each = F.when(F.col("side") == "a", F.transform(upto("blocks_b"), lambda j: pair(block, j, F.lit(False)))).otherwise(F.transform(upto("blocks_a"), lambda i: pair(i, block, F.lit(True))))
    unit = [*by, "lo", "hi"]
    met = met.select(*by, "id", "norm", "home", F.explode(each).alias("x")).select(*by, "x.lo", "x.hi", "id", "norm", "home", "x.right")
    met = spread_by(met, *unit).sortWithinPartitions(*unit)
    k = len(by)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            same = own and at[k] == at[k + 1]
            left, right = [r for r in held if not r[3]], held if same else [r for r in held if r[3]]
            if not left or not right:
                return
            ids, homes = np.array([r[0] for r in left], np.int64), [r[2] for r in left]
            out: list[tuple[np.ndarray, ...]] = []
            for i, j, s in block_pairs([r[1] for r in left], [r[1] for r in right], least):
                other = right[j][0]
                keep = ids[i] < other if same else np.ones(len(i), bool)
                if home:
                    keep &= np.array([homes[x] != right[j][2] for x in i.tolist()], bool)
                a, b = ids[i[keep]], np.full(int(keep.sum()), other, np.int64)
                out.append((np.minimum(a, b), np.maximum(a, b), s[keep]) if own else (a, b, s[keep]))
                if len(out) == 64:
                    yield together(out)
                    out = []
            if out:
                yield together(out)

        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in range(k + 2)), strict=True)
            for key, row in zip(keys, zip(*(b.column(i).to_pylist() for i in range(k + 2, k + 6)), strict=True), strict=True):
                if key != at:
                    if held:
                        yield from done()
                    at, held = key, []
                held.append(row)
        if held:
            yield from done()

    def together(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id_a", "id_b", "similarity"])

    return met.mapInArrow(compare, PAIR)


def similar_texts(texts: DataFrame, by: list[str], least: float, against: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b, similarity) of all pairs of unequal texts of a group that are at least `least` alike, each once.

    `texts`, `against`: `id` (a long, one for each group and text), `by`, `norm` (from `normal_texts`), and if need be `home`: a pair
    of equal homes is not wanted, and grams that occur in one home only are not joined. With `against`, pairs have one of each.
    """
    q = gram_size(least)
    home = "home" in texts.columns
    sides = [("a", texts)] if against is None else [("a", texts), ("b", against)]
    rows = None
    for side, f in sides:
        own = f.select("id", *by, "norm", (F.col("home") if home else F.lit(None).cast("string")).alias("home"), F.lit(side).alias("side"))
        rows = own if rows is None else rows.unionByName(own)
    rows = stored(rows.where("norm <> ''"))
    shared = rows.sparkSession.sparkContext.broadcast(_frequencies(rows, q))  # BUCKETS numbers
    keep = len(by) + 3

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                norms = b.column(keep).to_pylist()
                found = [prefix(x, least, q, shared.value) for x in norms]
                at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                sizes = pa.array([len(x) for x in norms], pa.int32())
                columns = [*[b.column(i).take(at) for i in range(keep)], sizes.take(at), pa.array([h for x in found for h in x], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:keep], "size", "token"])

    kinds = dict(rows.dtypes)
    listed = ["id", *by, "home", "side"]
    layout = ", ".join(f"{c} {kinds[c]}" for c in listed) + ", size int, token long"
    tokens = rows.select(*listed, "norm").mapInArrow(index, layout)
    if home:
        # a gram of one home alone brings no wanted pair together
        tokens = stored(tokens)
        several = tokens.groupBy(*by, "token").agg(F.min("home").alias("x"), F.max("home").alias("y")).where("x <> y").select(*by, "token")
        tokens = tokens.join(several, [*by, "token"], "left_semi")
    tokens = stored(tokens)
    dense = stored(_dense(rows, tokens, by, against is None))
    every = _by_blocks(rows, dense, by, least, home, against is None)
    tokens = tokens.join(F.broadcast(dense) if dense.count() <= FEW else dense, by, "left_anti")
    a, b = tokens.where("side = 'a'"), tokens.where("side = 'b'") if against is not None else tokens
    b = b.select(*by, "token", F.col("id").alias("id_b"), F.col("size").alias("size_b"), F.col("home").alias("home_b"))
    near = F.least("size", "size_b") * 2 >= least * (F.col("size") + F.col("size_b")) - 1e-9
    apart = ~F.col("home").eqNullSafe(F.col("home_b")) if home else F.lit(True)
    order = F.col("id") < F.col("id_b") if against is None else F.lit(True)
    pairs = a.join(b, [*by, "token"]).where(near & apart & order).select(F.col("id").alias("id_a"), "id_b").distinct()
    text = lambda side, n: rows.where(F.lit(True) if against is None else F.col("side") == side).select(F.col("id").alias(f"id_{n}"), F.col("norm").alias(f"norm_{n}")).distinct()
    met = pairs.join(text("a", "a"), "id_a").join(text("b", "b"), "id_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                found = [verified(x, y, least, q) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                at = pa.array([i for i, s in enumerate(found) if s is not None], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([s for s in found if s is not None], pa.float64())], names=["id_a", "id_b", "similarity"])

    return met.select("id_a", "id_b", "norm_a", "norm_b").mapInArrow(verify, PAIR).unionByName(every)
