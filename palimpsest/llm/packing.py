"""Best-fit packing: tokenised documents into sequences of a fixed number of tokens, by histogram patterns.

1. Every text is tokenised whole, and an end id follows. Only documents longer than a sequence are cut, the first
   piece taking what is left over. Full pieces are sequences of their own.
2. The histogram of the other pieces' lengths (fewer numbers than a sequence has tokens) gives, by non-negative least
   squares over patterns of two and three lengths, how often each pattern is repeated; what rounding leaves over
   is packed best-fit on the histogram.
3. A piece's rank among those of its length, counted in 64 hashed parts so that a hot length is many tasks' work, tells
   which repetition of which pattern takes it. The plan's size is bounded by the sequence's, not by the corpus.

Defined results: a null or empty text is its end id alone, one piece of length 1. Repeated rows and rows with equal or
null ids are packed each by itself. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.base import cut, per_batch, table
from palimpsest.llm.nnls import intervals, plan

_COMMA = re.compile(r",(?<=[^\W\d_],) (?=\S)")
_STOP = re.compile(r"\.(?<=[^\W\d_]\.) (?=\S)")
#: A space before white space or at the end.
_WIDE = re.compile(r" (?:\s|\Z)")

#: The vocabulary writes each byte as a printing character: those that print as themselves, the others from 256 on.
_PRINTING = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTING} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTING)}

_SPACE = chr(_BYTES[32])

#: The tokenizer's own first cut, for ASCII texts (a fixed value, its letter, digit and space classes spelt out).
_UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class Parts(dict):
    """Ids of parts of texts, tokenised at first sight; two generations bound its memory.

    A part is looked up without the space that stands before it.
    """

    def __init__(self, tokenizer, most: int):
        super().__init__()
        self.tokenizer, self.merges, self.most = tokenizer, tokenizer.model, most
        self.old: dict[str, bytes] = {}
        self.renew()

    def renew(self) -> None:
        """Begins a generation, if the present one is full or none has begun."""
        if len(self) >= self.most or not self:
            self.old = dict(self)
            self.clear()
            # these stand for a comma and a full stop that were cut off
            self.update({"\x01": self.unit(","), "\x02": self.unit(".")})

    def unit(self, text: str) -> bytes:
        """Ids of what the merges treat as one."""
        shown = text.replace(" ", _SPACE) if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            if part.isalpha():
                ids = self.unit(" " + part)
            elif part.isascii():
                ids = b"".join([self[x[1:]] if x[0] == " " and x[1:].isalpha() else self.unit(x) for x in _UNITS.findall(" " + part)])
            else:
                ids = array("I", self.tokenizer.encode(" " + part, add_special_tokens=False).ids).tobytes()
        self[part] = ids
        return ids


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer never merges across a space that a printing character follows, nor between a letter and a comma
    or full stop before such a space, so a text is cut there and each distinct part is tokenised once. Where a text holds
    an added token's content it has that token's id; such texts are not cut.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Parts(self.tokenizer, most)

    @staticmethod
    def parts(text: str) -> list[str]:
        """The text's parts; all but the first lack the space that they begin with."""
        if "\x01" in text or "\x02" in text:
            return [text]  # texts that hold the stand-ins are not cut at all
        text = _STOP.sub(" \x02 ", _COMMA.sub(" \x01 ", text))
        cut = text.split(" ")
        if not _WIDE.search(text):
            return cut
        out = [cut[0]]
        for x in cut[1:]:
            if x and not x[0].isspace():
                out.append(x)
            else:
                out[-1] += " " + x
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        find = self.known.__getitem__
        for text in texts:
            first, *rest = [text] if any(a in text for a in self.added) else self.parts(text)
            yield array("I", self.tokenizer.encode(first, add_special_tokens=False).ids).tobytes() + b"".join(map(find, rest))
            self.known.renew()


_encoders: dict[str, Encoder] = {}


def pieces_of(docs: DataFrame, tokenizer: str, size: int, end: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of whole documents."""
    mark = array("I", [end]).tobytes()

    def split(batch: dict[str, list]) -> dict[str, list]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for d, ids in zip(batch["doc_id"], _encoders[tokenizer].encode([t or "" for t in batch["text"]]), strict=True):
            ids += mark
            n = len(ids) // 4
            at, stop = 0, n % size or size
            piece = 0
            while at < n:
                for k, v in zip(out, (d, piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])), strict=True):
                    out[k].append(v)
                at, stop, piece = stop, stop + size, piece + 1
        return out

    return per_batch(docs.select("doc_id", "text"), "doc_id long, piece int, start long, length long, ids_crc32 long", split)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of `docs` (doc_id, text)."""
    pieces = cut(pieces_of(docs, tokenizer, size, end)).withColumn("__row", F.monotonically_increasing_id())
    full = pieces.where(F.col("length") == size).withColumns({"sequence_id": 2 * F.col("__row") + 1, "offset": F.lit(0).cast("long")})
    part = pieces.where(F.col("length") < size)
    # parts of about 2^16 rows if one length had them all
    part = part.withColumn("__part", F.pmod(F.xxhash64("__row"), F.lit(max(64, part.count() >> 16))))
    counts = cut(part.groupBy("length", "__part").agg(F.count("*").alias("n")))
    # fewer than `size` rows
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    keys, first, offset = intervals(plan(histogram, size)[0])
    w = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "__part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("length", "__part").orderBy("__row")) - 1
    ranked = part.join(before, ["length", "__part"]).withColumn("rank", rank).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    shared = docs.sparkSession.sparkContext.broadcast((keys, first, offset))

    def place(batch: dict[str, list]) -> dict[str, list]:
        keys, first, offset = shared.value
        rank = np.array(batch.pop("rank"), np.int64)
        at = np.searchsorted(keys, (np.array(batch["length"], np.int64) << 40) | rank, "right") - 1
        return batch | {"sequence_id": ((first[at] + rank) * 2).tolist(), "offset": offset[at].tolist()}

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return per_batch(ranked, kind, place).unionByName(full.select(*names))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
