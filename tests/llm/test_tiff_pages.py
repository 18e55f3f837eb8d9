"""TIFF pages after a bad one, of several samples a pixel, and of 16 bits."""

import struct

import numpy as np
import pytest
from palimpsest.llm import tiff


def one_page(image, order, planar, predictor):
    """A file of one strip (a plane) of `image`, rows by columns by samples."""
    bits, each = image.dtype.itemsize * 8, image.shape[2]
    parts = [image[:, :, i : i + 1] for i in range(each)] if planar else [image]
    if predictor == 2:
        parts = [np.concatenate([p[:, :1], p[:, 1:] - p[:, :-1]], axis=1) for p in parts]
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4))
    offsets, counts = [], []
    for p in parts:
        raw = p.astype(p.dtype.newbyteorder(order)).tobytes()
        offsets.append(len(out))
        counts.append(len(raw))
        out += raw + bytes(len(raw) & 1)
    fields = [(256, [image.shape[1]]), (257, [image.shape[0]]), (258, [bits] * each), (259, [1]), (262, [1]), (273, offsets), (277, [each]), (279, counts), (284, [2 if planar else 1]), (317, [predictor])]
    entries = b""
    for tag, values in fields:
        raw = struct.pack(f"{order}{len(values)}I", *values)
        if len(values) > 1:
            raw, more = struct.pack(order + "I", len(out)), raw
            out += more
        entries += struct.pack(order + "HHI", tag, 4, len(values)) + raw
    struct.pack_into(order + "I", out, 4, len(out))
    return bytes(out + struct.pack(order + "H", len(fields)) + entries + bytes(4))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("each", [1, 3])
def test_samples(order, planar, predictor, kind, each):
    image = np.random.default_rng(1).integers(0, np.iinfo(kind).max, (5, 7, each)).astype(kind)
    (p,) = tiff.read(one_page(image, order, planar, predictor))
    assert (p.samples_per_pixel, p.bits, p.samples) == (each, image.dtype.itemsize * 8, image.astype(image.dtype.newbyteorder("<")).tobytes())


def test_pages_after_a_bad_one(spark):
    data = bytearray(tiff.write([np.full((2, 3), i, np.uint8) for i in range(3)], tiff.NONE, 1, False))
    at = struct.unpack_from("<I", data, 4)[0]
    spots = [at + 2 + 12 * i for i in range(struct.unpack_from("<H", data, at)[0])]
    (spot,) = (s for s in spots if struct.unpack_from("<H", data, s)[0] == tiff.BITS)
    struct.pack_into("<I", data, spot + 8, 4)
    got = tiff.pages(spark.createDataFrame([(1, data)], "k long, media binary"), "k", "media").collect()
    assert [(r.page, r.samples, r.error is None) for r in got] == [(0, None, False), (1, bytearray([1] * 6), True), (2, bytearray([2] * 6), True)]


def test_malformed_files_give_error_rows():
    """Files with any bytes changed or cut off: pages or errors come back, never another exception, and not without end."""
    rng = np.random.default_rng(4)
    files = [tiff.write([rng.integers(0, 9, (40, 70)).astype(np.uint8)] * 2, c, p, t) for c, p in ((tiff.LZW, 2), (tiff.PACKBITS, 1), (tiff.DEFLATE, 2), (tiff.NONE, 1)) for t in (False, True)]
    seen = 0
    for data in files:
        for _ in range(250):
            bad = bytearray(data)
            ends = [len(data) - 1 - int(rng.integers(0, min(400, len(data)))) for _ in range(rng.integers(1, 4))]
            for at in ends if rng.random() < 0.7 else rng.integers(0, len(data), 3):
                bad[at] = rng.choice([0, 1, 255, int(rng.integers(0, 256))])
            bad = bad[: rng.integers(8, len(bad))] if rng.random() < 0.2 else bad
            got = list(tiff.directories(bytes(bad)))
            assert all(isinstance(p, tiff.Page | tiff.TiffError) for p in got) and len(got) < 100
            assert all(len(p.samples) == p.width * p.height * p.samples_per_pixel * p.bits // 8 for p in got if isinstance(p, tiff.Page))
            seen += any(isinstance(p, tiff.TiffError) for p in got)
    assert seen > 200


def patched(tag, value, data=None):
    data = bytearray(data or tiff.write([np.full((32, 20), 7, np.uint8)], tiff.DEFLATE, 1, tag in (322, 323)))
    at = struct.unpack_from("<I", data, 4)[0]
    (spot,) = (at + 2 + 12 * i for i in range(struct.unpack_from("<H", data, at)[0]) if struct.unpack_from("<H", data, at + 2 + 12 * i)[0] == tag)
    struct.pack_into("<I", data, spot + 8, value)
    return bytes(data)


@pytest.mark.parametrize(("tag", "value"), [(256, 0), (257, 0), (257, 2**31), (256, 2**31), (257, 64), (322, 0), (323, 0), (259, 7), (317, 9), (258, 4)])
def test_impossible_directories(tag, value):
    data = patched(tag, value) if tag != 317 else patched(317, value, tiff.write([np.full((32, 20), 7, np.uint8)], tiff.DEFLATE, 2, False))
    assert [type(p) for p in tiff.directories(data)] == [tiff.TiffError]


@pytest.mark.parametrize("order", ["<", ">"])
def test_floating_point_predictor_and_fill_order(order):
    image = np.random.default_rng(2).normal(0, 100, (3, 5, 2)).astype(np.float32)
    ranks = image.astype(">f4").view(np.uint8).reshape(3, 10, 4).transpose(0, 2, 1).reshape(3, 20, 2)
    steps = np.concatenate([ranks[:, :1], ranks[:, 1:] - ranks[:, :-1]], axis=1)
    as_ints = np.frombuffer(steps.astype(np.uint8).tobytes(), order + "u4").astype(np.uint32).reshape(3, 5, 2)
    data = bytearray(one_page(as_ints, order, False, 1))
    at = struct.unpack_from(order + "I", data, 4)[0]
    spot = next(at + 2 + 12 * i for i in range(10) if struct.unpack_from(order + "H", data, at + 2 + 12 * i)[0] == 317)
    struct.pack_into(order + "I", data, spot + 8, 3)
    (p,) = tiff.read(bytes(data))
    assert (p.bits, np.frombuffer(p.samples, "<f4").tolist()) == (32, image.reshape(-1).tolist())
    data = bytearray(one_page(np.arange(12, dtype=np.uint8).reshape(3, 4, 1), order, False, 1))
    at = struct.unpack_from(order + "I", data, 4)[0]
    struct.pack_into(order + "H", data, at + 2 + 12 * 4, 266)  # the photometric field, read by nobody, becomes the fill order
    struct.pack_into(order + "I", data, at + 2 + 12 * 4 + 8, 2)
    (p,) = tiff.read(bytes(data))
    assert list(p.samples) == [int(f"{i:08b}"[::-1], 2) for i in range(12)]


def test_the_query(spark, tmp_path):
    """All columns of the query, computed plainly from the payload and the file it is stored in."""
    import hashlib
    import zlib

    texts = [None, "", "a", "é" * 400, "line\n" * 3000, *(f"text number {i} " * (i + 1) for i in range(40))]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, texts[3])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kinds = set()
    for r in tiff.op5_media_tiff(spark, str(tmp_path)).collect():
        choices = {texts[r.doc_id], texts[3]} if r.doc_id == 7 else {texts[r.doc_id]}
        raw = next(t for t in ((c or "").encode() for c in choices) if len(t) == r.n_bytes)
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        media = tiff.stored(full)
        first = next(iter(tiff.read(media)))
        kinds.add((first.compression, first.predictor, first.tiled))
        spread = [sum(b >> 4 == k for b in full) for k in range(16)]
        feature = f"sum={sum(full)};steps={sum(abs(a - b) for a, b in zip(full, full[1:], strict=False))};hist=" + ".".join(map(str, spread))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), feature)
    assert {c for c, _, _ in kinds} == {tiff.LZW, tiff.PACKBITS, tiff.DEFLATE} and {(tiff.LZW, 2), (tiff.LZW, 1), (tiff.DEFLATE, 2), (tiff.DEFLATE, 1)} <= {k[:2] for k in kinds}
