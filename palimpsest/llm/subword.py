"""Subword-bag embeddings averaged into a linear softmax, in numpy: the model behind `toxicity`.

Every word adds itself and its character n-grams (bytes, word edges included) to its text's bag, once. A bag's
vector is the mean of its features' embeddings and of `calm` zero vectors, so that a few words weigh little; a
softmax over two labels reads that vector. Its bias stays at `empty`, the log-odds of a text that says nothing:
label 1 has to be earned. Embeddings and softmax are trained jointly with Adagrad. A misspelt word shares most
n-grams, hence vectors, with the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from palimpsest.llm.text import Buffer, mix, pieces

U64 = np.uint64
#: Word bytes: letters, digits and all non-ASCII bytes (after lower-casing).
_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Shape:
    """Fixed sizes of the model; none of them follows the corpus."""

    buckets: int = 1 << 18
    dim: int = 8
    grams: tuple[int, ...] = (3, 4, 5, 6)
    steps: int = 30_000
    balance: float = 0.0
    rate: float = 0.4
    calm: float = 1500.0
    empty: float = -2.0
    seed: int = 17


def _grams(texts: list[str | None], shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words, then for each n-gram length: feature buckets in text order, and each text's offsets into them.

    A word counts once in a text, so that one that is said over and over does not make up the whole bag.
    """
    b = Buffer(texts)
    start, end, doc = b.spans(_SEP)
    words = b.hashes(start, end)
    _, once = np.unique(words ^ mix(doc.astype(U64) + U64(1)), return_index=True)
    once.sort()
    start, end = start[once], end[once]
    mask = U64(shape.buckets - 1)
    edges = np.append(b.first, len(b.data))
    yield ((words[once] ^ U64(0x51)) & mask).astype(np.int64), np.searchsorted(start, edges)
    # n-grams see each word with one edge byte on either side; all separators look alike there
    sep = _SEP[b.data]
    b.data, b._prefix = np.where(sep, np.uint8(10), b.data), None
    seps = np.cumsum(sep, dtype=np.int32)  # separators up to and with a position
    turn = np.zeros(len(sep) + 1, np.int8)
    turn[start], turn[end] = 1, -1
    kept = np.cumsum(turn, dtype=np.int8)[:-1].astype(bool)  # letters of a word's first place
    for k in shape.grams:
        # only a window's first or last byte may be a separator
        ok = (seps[k - 2 : -1] == seps[: 1 - k]) & kept[1 : 2 - k if k > 2 else None] if len(sep) >= k else np.zeros(0, bool)
        at = np.flatnonzero(ok)
        yield (b.windows(at, k) & mask).astype(np.int64), np.searchsorted(at + 1, edges)


def features(texts: list[str | None], shape: Shape) -> list[np.ndarray]:
    """Feature buckets of each text."""
    parts = list(_grams(texts, shape))
    return [np.concatenate([f[o[i] : o[i + 1]] for f, o in parts]) for i in range(len(texts))]


def train(texts: list[str | None], labels: np.ndarray, shape: Shape) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): what the trained softmax reads from a feature, as the log-odds it adds.

    As the softmax is linear and the vector a mean, the log-odds of label 1 are the mean over the bag of
    (w1 - w0) . embedding, plus a bias; so scoring needs one number a bucket.
    """
    rng = np.random.default_rng(shape.seed)
    emb = rng.uniform(-1.0 / shape.dim, 1.0 / shape.dim, (shape.buckets, shape.dim)).astype(np.float32)
    out = np.zeros((2, shape.dim), np.float32)
    out[1], out[0] = 0.5, -0.5
    bias = np.array([0, shape.empty], np.float32)
    g_emb = np.full(shape.buckets, 1e-8, np.float32)
    g_out = np.full((2, shape.dim), 1e-8, np.float32)
    bags = []
    for a, z in pieces(texts, 1 << 19):
        for f in features(texts[a:z], shape):
            u, k = np.unique(f.astype(np.int32), return_counts=True)
            bags.append((u, (k / (shape.calm + k.sum())).astype(np.float32)))
    share = np.bincount(labels, minlength=2)[labels] / len(labels)
    weight = (0.5 / share) ** shape.balance
    # passes over few texts are many, so that a small sample is learnt as well
    for _ in range(-(-shape.steps // max(1, len(bags)))):
        for i in rng.permutation(len(bags)):
            u, k = bags[i]
            if not len(u):
                continue
            e = emb[u]
            v = k @ e
            z = out @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= np.float32(weight[i])
            back = p @ out
            step = k[:, None] * back
            d_out = np.outer(p, v)
            g_emb[u] += (step * step).mean(1)
            emb[u] = e - shape.rate * step / np.sqrt(g_emb[u])[:, None]
            g_out += d_out * d_out
            out -= shape.rate * d_out / np.sqrt(g_out)
    return (emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def log_odds(texts: list[str | None], weights: np.ndarray, bias: float, shape: Shape) -> np.ndarray:
    """Log-odds of label 1 of whole texts; a text without words gets the bias alone."""
    out = np.empty(len(texts))
    for a, z in pieces(texts, 1 << 19):
        total, count = np.zeros(z - a), np.zeros(z - a)
        for f, off in _grams(texts[a:z], shape):
            c = np.concatenate([[0.0], np.cumsum(weights[f], dtype=np.float64)])
            total += c[off[1:]] - c[off[:-1]]
            count += np.diff(off)
        out[a:z] = total / (shape.calm + count) + bias
    return out
