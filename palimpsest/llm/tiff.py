"""Media columns: TIFF. Reads images from bytes: directories, strips or tiles, PackBits, LZW, deflate, predictors.

`pages` emits one row for each page (image directory) of a binary column. `write` makes the files that the query reads back.

Samples of a pixel stand side by side, those of 16 and 32 bits little-endian, whether the file holds them so or plane by plane.

Defined results: bytes that are no TIFF, or a page that cannot be decoded, give one row with the reason in `error`
and null samples; the pages after a bad one follow as long as the chain of directories can be read. Such errors are
missing or short blocks, sizes that the data cannot hold, other sample sizes than 8, 16 and 32 bits, other compressions
than the above, and other predictors than none, horizontal and, for 16 and 32 bits, floating point. Both byte orders and
both fill orders are read. Null media give no row. A text's payload is its UTF-8 bytes, filled up with bytes 255 to a
positive multiple of 576; a null text is empty. Equal texts give equal files, whatever their ids.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.base import per_batch, table

WIDTH = 576
#: Rows of a page at most, rows of a strip, columns and rows of a tile (multiples of 16; low ones, as most texts fill few rows).
PAGE_ROWS, STRIP_ROWS, TILE_WIDE, TILE_HIGH = 128, 16, 192, 16

#: Fixed values of the format: compressions, and sizes of field types.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: The tags that are read.
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR = 273, 277, 278, 279, 317
PLANES, FILL_ORDER = 284, 266
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325


#: No compression here makes data longer than so many times; an image that declares more is not decoded.
MOST_EXPANDED = 4096
#: Bytes with their bits in reverse, as files of fill order 2 have them.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class TiffError(ValueError):
    pass


def packbits_decode(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i += head + 2
        elif head == 128:
            i += 1
        else:
            out.append(data[i + 1 : i + 2] * (257 - head))
            i += 2
    return b"".join(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    out, at = [], 0

    def literal(a: int, b: int) -> None:
        for i in range(a, b, 128):
            part = data[i : min(i + 128, b)]
            out.append(bytes([len(part) - 1]) + part)

    for m in _RUN.finditer(data):
        literal(at, m.start())
        out.append(bytes([257 - (m.end() - m.start()), data[m.start()]]))
        at = m.end()
    literal(at, len(data))
    return b"".join(out)


#: Fixed values of LZW: the codes that clear the table and end the data, and how many codes a full table has.
CLEAR, END, FULL = 256, 257, 4095


def _widths(n: int) -> np.ndarray:
    """Bits of the n codes that follow a clear: a code grows one entry early, up to 12 bits."""
    return np.minimum(12, np.frexp(np.arange(258, 258 + n))[1])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first: the longest known prefixes, the table cleared when it is full."""
    codes: list[int] = []
    starts = [0]  # places right after a clear
    put, table, following = codes.append, {}, 258
    get = table.get
    rest = iter(data)
    prefix = next(rest, END)
    for byte in rest:
        key = prefix << 8 | byte
        code = get(key)
        if code is None:
            put(prefix)
            table[key] = following
            prefix = byte
            following += 1
            if following == FULL:
                put(CLEAR)
                starts.append(len(codes))
                table.clear()
                following = 258
        else:
            prefix = code
    put(prefix)
    if data:
        put(END)
    ends = [*starts[1:], len(codes)]
    width = np.concatenate([[9], *(_widths(z - a) for a, z in zip(starts, ends, strict=True))])
    value = np.array([CLEAR, *codes], np.int64)
    bits = value[:, None] >> np.arange(11, -1, -1) & 1
    return np.packbits(bits[np.arange(12) >= 12 - width[:, None]].astype(np.uint8)).tobytes()


def _phrases(codes: np.ndarray) -> bytes:
    """The bytes that the codes after a clear stand for, as whole arrays.

    Code 258 + j is the phrase of the j-th code and the first byte of the next one, so a code's bytes follow from
    those of earlier codes: lengths and first bytes by doubling the steps to the literal that each begins with, the
    others from last to first.
    """
    every = np.arange(len(codes))
    literal = codes < 256
    parent = np.where(literal, every, codes - 258)
    if (parent[~literal] >= every[~literal]).any():
        raise TiffError("an LZW code beyond the table")
    root, steps = parent.copy(), (~literal).astype(np.int64)
    while not literal[root].all():
        steps += steps[root]
        root = root[root]
    first = codes[root]
    last = np.where(literal, codes, first[np.minimum(parent + 1, every)]).astype(np.uint8)
    at = np.cumsum(steps + 1) - 1
    out = np.empty(at[-1] + 1, np.uint8)
    while len(every):
        out[at] = last[every]
        on = ~literal[every]
        every, at = parent[every[on]], at[on] - 1
    return out.tobytes()


def lzw_decode(data: bytes) -> bytes:
    """Everything up to the end code or the end of the data."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out: list[bytes] = []
    bit, size = 0, 8 * len(data)
    while True:
        # codes up to the next clear; a table that is full before it keeps codes of 12 bits and takes no more entries
        width = _widths(max(0, size - bit) // 9)
        place = bit + np.cumsum(width) - width
        inside = place + width <= size
        place, width = place[inside], width[inside]
        codes = words[place >> 3] >> (32 - width - (place & 7)) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stop[0]) if len(stop) else len(codes)
        if n:
            if codes[0] > END:
                raise TiffError("an LZW strip does not begin with a byte")
            out.append(_phrases(codes[:n]))
        if not len(stop) or codes[n] == END:
            return b"".join(out)
        bit = int(place[n] + width[n])


def _packed(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    return {LZW: lzw_encode, PACKBITS: packbits_encode, DEFLATE: lambda d: zlib.compress(d, 6)}[compression](data)


def _unpacked(data: bytes, compression: int, need: int) -> bytes:
    """At least the first `need` bytes, if there are as many."""
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, need + 1)  # one more, so that a stream's checksum is read
    if compression in (LZW, PACKBITS):
        return (lzw_decode if compression == LZW else packbits_decode)(data)
    raise TiffError(f"compression {compression} is not supported")


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    compression: int
    predictor: int
    tiled: bool
    samples: bytes
    samples_per_pixel: int = 1
    bits: int = 8


def write(images: list[np.ndarray], compression: int, predictor: int, tiled: bool) -> bytes:
    """A little-endian file of one page for each image (rows of 8-bit grey samples)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        height, width = image.shape
        if tiled:
            high, wide = -(-height // TILE_HIGH) * TILE_HIGH, -(-width // TILE_WIDE) * TILE_WIDE
            full = np.zeros((high, wide), np.uint8)
            full[:height, :width] = image
            blocks = [full[y : y + TILE_HIGH, x : x + TILE_WIDE] for y in range(0, high, TILE_HIGH) for x in range(0, wide, TILE_WIDE)]
        else:
            blocks = [image[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            data = _packed(b.tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        fields = [(IMAGE_WIDTH, [width]), (IMAGE_LENGTH, [height]), (BITS, [8]), (COMPRESSION, [compression]), (PHOTOMETRIC, [1])]
        fields += [(SAMPLES, [1])] + ([(PREDICTOR, [predictor])] if predictor != 1 else [])
        if tiled:
            fields += [(TILE_WIDTH, [TILE_WIDE]), (TILE_LENGTH, [TILE_HIGH]), (TILE_OFFSETS, offsets), (TILE_COUNTS, counts)]
        else:
            fields += [(STRIP_OFFSETS, offsets), (ROWS_PER_STRIP, [STRIP_ROWS]), (STRIP_COUNTS, counts)]
        entries = b""
        for tag, values in sorted(fields):
            raw = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                raw, at = struct.pack("<I", len(out)), raw
                out += at
            entries += struct.pack("<HHI", tag, 4, len(values)) + raw
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries) // 12) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _fields(data: bytes, at: int, order: str) -> dict[int, list[int]]:
    """An image directory's whole-number fields by tag."""
    (n,) = struct.unpack_from(order + "H", data, at)
    out = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in (1, 3, 4):
            continue
        spot = at + 10 + 12 * i
        if _SIZES[kind] * count > 4:
            (spot,) = struct.unpack_from(order + "I", data, spot)
        if spot + _SIZES[kind] * count > len(data):
            raise TiffError("a field beyond the end")
        out[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, spot))
    return out


def _page(data: bytes, f: dict[int, list[int]], order: str) -> Page:
    one = lambda tag, default: f.get(tag, [default])[0]
    if IMAGE_WIDTH not in f or IMAGE_LENGTH not in f:
        raise TiffError("a directory without an image size")
    width, height = f[IMAGE_WIDTH][0], f[IMAGE_LENGTH][0]
    each, bits = one(SAMPLES, 1), one(BITS, 1)
    if not each or bits not in (8, 16, 32) or set(f.get(BITS, [1])) != {bits}:
        raise TiffError("not samples of 8, 16 or 32 bits")
    compression, predictor, tiled = one(COMPRESSION, 1), one(PREDICTOR, 1), TILE_OFFSETS in f
    if predictor not in (1, 2, 3) or (predictor == 3 and bits == 8):
        raise TiffError(f"predictor {predictor} is not supported for {bits} bits")
    offsets, counts = (f[TILE_OFFSETS], f[TILE_COUNTS]) if tiled else (f[STRIP_OFFSETS], f[STRIP_COUNTS])
    wide, high = (f[TILE_WIDTH][0], f[TILE_LENGTH][0]) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if not (width and height and wide and high):
        raise TiffError("an image or block without pixels")
    planes = each if one(PLANES, 1) == 2 else 1
    side = each // planes  # samples that stand side by side in a block
    across = -(-width // wide)
    blocks = across * -(-height // high)
    if min(len(offsets), len(counts)) < blocks * planes:
        raise TiffError("strips or tiles are missing")
    if any(o + c > len(data) for o, c in zip(offsets, counts, strict=False)):
        raise TiffError("a strip or tile beyond the end")
    if wide * high * blocks * each * bits // 8 > MOST_EXPANDED * max(64, sum(counts[: blocks * planes])):
        raise TiffError("an image larger than its data can hold")
    image = np.zeros((height, width, each), f"<u{bits // 8}")
    for k, (o, c) in enumerate(zip(offsets[: blocks * planes], counts[: blocks * planes], strict=True)):
        plane, k = divmod(k, blocks)
        y, x = k // across * high, k % across * wide
        rows = high if tiled else min(high, height - y)
        need = rows * wide * side * bits // 8
        raw = data[o : o + c].translate(_REVERSED) if one(FILL_ORDER, 1) == 2 else data[o : o + c]
        raw = _unpacked(raw, compression, need)
        if len(raw) < need:
            raise TiffError("a strip or tile is too short")
        block = _unpredicted(np.frombuffer(raw[:need], np.uint8), predictor, (rows, wide, side), bits // 8, order)
        part = image[y : y + rows, x : x + wide, plane : plane + side]
        part[:] = block[: part.shape[0], : part.shape[1]]
    return Page(width, height, compression, predictor, tiled, image.tobytes(), each, bits)


def _unpredicted(raw: np.ndarray, predictor: int, shape: tuple[int, int, int], size: int, order: str) -> np.ndarray:
    """A block's samples (rows, columns, samples side by side), each of `size` bytes."""
    rows, wide, side = shape
    if predictor == 3:
        # bytes of equal rank stand together, the highest first, each the difference to the one `side` before it
        steps = raw.reshape(rows, wide * size, side)
        ranks = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, size, wide * side)
        return np.ascontiguousarray(ranks.transpose(0, 2, 1)).view(f">u{size}").reshape(shape)
    block = raw.view(f"{order}u{size}").reshape(shape)
    return np.cumsum(block, axis=1, dtype=f"u{size}") if predictor == 2 else block


def directories(data: bytes) -> Iterator[Page | TiffError]:
    """The pages of a file in the order of its chain of directories, an error in the place of each that can't be decoded."""
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        yield TiffError("no TIFF header")
        return
    order = "<" if data[:2] == b"II" else ">"
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            yield TiffError("the chain of directories is a loop")
            return
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", data, at)
            (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        except struct.error as e:
            yield TiffError(str(e))
            return
        try:
            page: Page | TiffError = _page(data, _fields(data, at, order), order)
        except TiffError as e:
            page = e
        except (struct.error, zlib.error, KeyError, IndexError, ValueError, ArithmeticError, MemoryError) as e:
            page = TiffError(f"{type(e).__name__}: {e}")
        yield page
        at = following


def read(data: bytes) -> Iterator[Page]:
    """The pages of a file; the first that can't be decoded is raised."""
    for page in directories(data):
        if isinstance(page, TiffError):
            raise page
        yield page


def pages(media: DataFrame, key: str, column: str) -> DataFrame:
    """(key, page, width, height, compression, predictor, tiled, samples, samples_per_pixel, bits, error): one row for each page of `column`.

    A file's rows follow one another in the order of its pages.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = ("width", "height", "compression", "predictor", "tiled", "samples", "samples_per_pixel", "bits")
    kind = T.StructType([T.StructField(key, media.schema[key].dataType), *T._parse_datatype_string("page int, width long, height long, compression int, predictor int, tiled boolean, samples binary, samples_per_pixel int, bits int, error string")])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        done = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        size = 0
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for n, p in enumerate(directories(data.as_py()) if data.is_valid else ()):
                    bad = isinstance(p, TiffError)
                    out.append((k, n, *([None] * 8 if bad else [getattr(p, x) for x in names]), str(p) if bad else None))
                    size += 0 if bad else len(p.samples)
                    if size > 2_000_000 or len(out) >= 1024:
                        yield done()
                        out, size = [], 0
        if out:
            yield done()

    return media.select(key, column).mapInArrow(run, kind)


def stored(payload: bytes) -> bytes:
    """The file of a payload: pages of up to PAGE_ROWS rows.

    Its digest deals LZW, PackBits and deflate evenly, strips or tiles, and both predictors to LZW and deflate, for
    which the format defines them.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    d = hashlib.sha256(payload).digest()
    compression = (LZW, PACKBITS, DEFLATE)[d[0] % 3]
    predictor = 2 if compression != PACKBITS and d[1] % 2 else 1
    return write([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], compression, predictor, d[2] % 2 == 1)


def media_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text's payload as a file."""

    def make(batch: dict[str, list]) -> dict[str, list]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
        full = [r + b"\xff" * (-len(r) % WIDTH if r else WIDTH) for r in raw]
        return {"doc_id": batch["doc_id"], "n_bytes": [len(r) for r in raw], "media": [stored(p) for p in full]}

    return per_batch(docs.select("doc_id", "text"), "doc_id long, n_bytes long, media binary", make)


def digests(media: DataFrame) -> DataFrame:
    """What the rows of `pages` hold of every file, put together again; a page that cannot be read fails the job."""
    own = F.struct(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = None, []

        def done() -> tuple:
            payload = b"".join(held)
            v = np.frombuffer(payload, np.uint8)
            spread = np.bincount(v >> 4, minlength=16)
            steps = int(np.abs(np.diff(v.astype(np.int16))).sum())
            feature = f"sum={int(v.sum(dtype=np.int64))};steps={steps};hist=" + ".".join(map(str, spread.tolist()))
            return file["doc_id"], file["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), file["media_bytes"], file["media_sha256"], feature, len(held)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out = []
            for f, samples, error in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if error is not None:
                    raise TiffError(error)
                if file is not None and f["row"] != file["row"]:
                    out.append(done())
                    held = []
                file = f
                held.append(samples)
            if out:
                yield batch_of(out)
        if file is not None:
            yield batch_of([done()])

    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"
    return pages(media.select(own.alias("file"), "media"), "file", "media").select("file", "samples", "error").mapInArrow(put_together, kind)


def op5_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(media_of(table(spark, sf_dir, "documents")))
