"""Fast similarity sketching: rounds of hashed bin placement that fill every coordinate of a MinHash sketch.

Round i of the first t throws each element into a random bin with the value i + fraction; round t + j throws all
elements into bin j, so that after at most 2t rounds no bin is empty. A bin keeps its smallest value. Most sets
are done after a few rounds, as a text stops as soon as its bins are full. Two sets agree in a coordinate with
probability equal to their Jaccard similarity, with Chernoff-like concentration over the coordinates.
"""

from __future__ import annotations

import numpy as np

from palimpsest.llm.text import mix

U64 = np.uint64
_NONE = np.uint64(2**64 - 1)


def sketches(elements: np.ndarray, offsets: np.ndarray, t: int, seed: int = 1) -> np.ndarray:
    """One row of t values for each set; sets lie end to end in `elements`; an empty set's row is all ones."""
    n = len(offsets) - 1
    out = np.full(n * t, _NONE, U64)
    of = np.repeat(np.arange(n), np.diff(offsets))
    x = elements
    seeds = np.random.default_rng(seed).integers(1, 1 << 62, 2 * t, dtype=np.uint64)
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x ^ seeds[i])
        # top 16 bits place, the low 48 are the fraction, the round stands above them
        at = ((h >> U64(48)) * U64(t) >> U64(16)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, of * t + at, (U64(i) << U64(48)) | (h & U64((1 << 48) - 1)))
        live = np.unique(of)
        full = np.zeros(n, bool)
        full[live] = (out.reshape(n, t)[live] != _NONE).all(1)
        if full.any():
            keep = ~full[of]
            x, of = x[keep], of[keep]
    return out.reshape(n, t)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of the bands of `rows` coordinates; the band's number is part of the key."""
    n, t = sketch.shape
    parts = sketch[:, : t // rows * rows].reshape(n, -1, rows)
    key = np.arange(parts.shape[1], dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15) + U64(1)
    for r in range(rows):
        key = mix(key * U64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key.view(np.int64)


def bytes_of(sketch: np.ndarray) -> np.ndarray:
    """One byte a coordinate: enough to tell how much two sketches agree."""
    return (mix(sketch) & U64(255)).astype(np.uint8)
