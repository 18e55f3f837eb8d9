"""Vectorised text helpers that run inside Spark tasks: words, hashes and shingle sets of an Arrow batch.

A batch's texts are laid out in one byte buffer with a line feed around every text, so that no word and
no window of bytes ever crosses from one text to the next. All hashes are 64-bit polynomial prefix hashes
over random byte values, finished by a mixer; equal bytes give equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
#: Random value of each byte, from a seeded generator.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

#: Separators of the contracts' words `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _grow(n: int) -> None:
    """Tables of the base's powers and of their inverses, for positions up to n."""
    have = len(_powers[0])
    if have >= n:
        return
    size = 1 << max(20, int(n - 1).bit_length())
    for k, b in enumerate((_BASE, _INV)):
        steps = np.full(size, U64(b & (2**64 - 1)))
        steps[0] = 1
        _powers[k] = np.cumprod(steps, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (two rounds of xor-shift and multiply)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Buffer:
    """Texts of a batch as bytes; `first[i]`..`last[i]` is where text i lies in `data`."""

    def __init__(self, texts: list[str | None], lower: bool = True):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
        self.last = np.cumsum(size + 1)
        self.first = self.last - size
        self.n = len(raw)
        if lower:
            self.data = LOWER[self.data]
        self._prefix: np.ndarray | None = None

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            n = len(self.data)
            _grow(n + 1)
            out = np.zeros(n + 1, U64)
            np.cumsum(_BYTE[self.data] * _powers[0][:n], out=out[1:])
            self._prefix = out
        return self._prefix

    def spans(self, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word (longest runs of bytes that are not separators)."""
        word = ~sep[self.data]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        return start, end, np.searchsorted(self.last, start)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes in each span."""
        c = self.prefix()
        return mix((c[end] - c[start]) * _powers[1][start] + (end - start).astype(U64))

    def windows(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k bytes from each position on."""
        c = self.prefix()
        return mix((c[at + k] - c[at]) * _powers[1][at] + U64(k))


def shingle_sets(words: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, sorted, end to end, and offsets into them.

    A text of fewer than n words has its whole sequence as its one shingle; one without words has none.
    """
    count = np.bincount(doc, minlength=n_docs)
    short = (count > 0) & (count < n)
    m = len(words)
    acc = np.zeros(max(0, m - n + 1), U64)
    for j in range(n):
        acc = acc * U64(0xD6E8FEB86659FD93) + words[j : m - n + 1 + j] if m >= n else acc
    acc = mix(acc)
    of = doc[: max(0, m - n + 1)]
    inside = of == doc[n - 1 :] if m >= n else np.zeros(0, bool)
    acc, of = acc[inside], of[inside]
    if short.any():
        more, where = [], np.flatnonzero(short)
        first = np.searchsorted(doc, where)
        for d, f in zip(where, first, strict=True):
            h = np.full(1, 0x1234567, U64)
            for w in words[f : f + count[d]]:
                h = mix(h * U64(0xD6E8FEB86659FD93) + w)
            more.append(h)
        acc, of = np.concatenate([acc, *more]), np.concatenate([of, where])
        order = np.argsort(of, kind="stable")
        acc, of = acc[order], of[order]
    bounds = np.searchsorted(of, np.arange(n_docs + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        acc[a:b].sort()
    keep = np.ones(len(acc), bool)
    keep[1:] = (acc[1:] != acc[:-1]) | (of[1:] != of[:-1])
    acc, of = acc[keep], of[keep]
    return acc, np.searchsorted(of, np.arange(n_docs + 1))


def pieces(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters, so that working memory follows the range, not the batch."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield at, i
            at, size = i, 0
        size += len(t or "") + 1
    if at < len(texts):
        yield at, len(texts)
