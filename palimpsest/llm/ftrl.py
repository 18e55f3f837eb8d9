"""Logistic regression over hashed word n-grams, trained with follow-the-regularised-leader, in numpy.

Tokens are runs of letters and digits and runs of other printing characters, case kept, so that shouting,
table bars and symbol noise are words too; a bigram of one token twice is one feature whatever the token. A text's feature values are its n-grams' shares, times `gain`; the bias stays at
`empty`, the log-odds of a text that says nothing, so that such a text is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from palimpsest.llm.text import SPACE, Buffer, mix, pieces

U64 = np.uint64
_KIND = np.full(256, 2, np.uint8)
_KIND[SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass(frozen=True)
class Shape:
    """Fixed sizes and rates of the model; none of them follows the corpus."""

    buckets: int = 1 << 18
    grams: int = 2
    gain: float = 100.0
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    epochs: int = 3
    empty: float = 2.0
    seed: int = 11


def _grams(texts: list[str | None], shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, ..: buckets of the n-grams in text order, and each text's offsets into them."""
    b = Buffer(texts, lower=False)
    kind = _KIND[b.data]
    edge = np.append(0, np.flatnonzero(kind[1:] != kind[:-1]) + 1)
    end = np.append(edge[1:], len(kind))
    keep = kind[edge] > 0
    start, end = edge[keep], end[keep]
    doc = np.searchsorted(b.last, start)
    words = b.hashes(start, end)
    bounds = np.arange(b.n + 1)
    acc = np.zeros(len(words), U64)
    for n in range(1, shape.grams + 1):
        acc = acc[: len(words) - n + 1] * U64(0xD6E8FEB86659FD93) + words[n - 1 :]
        inside = doc[: len(acc)] == doc[n - 1 :] if len(acc) else np.zeros(0, bool)
        if n == 2:  # a token said twice is one feature, whichever token it is
            acc = np.where(words[: len(acc)] == words[1:], U64(7), acc)
        f = (mix(acc[inside] + U64(n)) & U64(shape.buckets - 1)).astype(np.int64)
        yield f, np.searchsorted(doc[: len(acc)][inside], bounds)


def train(texts: list[str | None], labels: np.ndarray, shape: Shape) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) after FTRL-proximal passes, one text at a time, in a seeded order."""
    z, n = np.zeros(shape.buckets), np.zeros(shape.buckets)
    bias = shape.empty
    rows = []
    for a, e in pieces(texts, 1 << 19):
        parts = list(_grams(texts[a:e], shape))
        for i in range(e - a):
            u, k = np.unique(np.concatenate([f[o[i] : o[i + 1]] for f, o in parts]).astype(np.int32), return_counts=True)
            rows.append((u, (k * (shape.gain / max(1, k.sum()))).astype(np.float32)))

    def weights(zu: np.ndarray, nu: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zu) * np.maximum(np.abs(zu) - shape.l1, 0)
        return -shrunk / ((shape.beta + np.sqrt(nu)) / shape.alpha + shape.l2)

    rng = np.random.default_rng(shape.seed)
    for _ in range(shape.epochs):
        for i in rng.permutation(len(rows)):
            u, x = rows[i]
            w = weights(z[u], n[u])
            g0 = 1 / (1 + np.exp(-np.clip(w @ x + bias, -30, 30))) - labels[i]
            g = g0 * x
            sigma = (np.sqrt(n[u] + g * g) - np.sqrt(n[u])) / shape.alpha
            z[u] += g - sigma * w
            n[u] += g * g
    return weights(z, n).astype(np.float32), float(bias)


def log_odds(texts: list[str | None], weights: np.ndarray, bias: float, shape: Shape) -> np.ndarray:
    """Log-odds of label 1 of whole texts: a sparse dot product each; a text without words gets the bias alone."""
    out = np.empty(len(texts))
    for a, e in pieces(texts, 1 << 19):
        total, count = np.zeros(e - a), np.zeros(e - a)
        for f, off in _grams(texts[a:e], shape):
            c = np.concatenate([[0.0], np.cumsum(weights[f], dtype=np.float64)])
            total += c[off[1:]] - c[off[:-1]]
            count += np.diff(off)
        out[a:e] = shape.gain * total / np.maximum(1, count) + bias
    return out
