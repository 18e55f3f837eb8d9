"""Histogram packing by non-negative least squares: which length patterns to repeat how often.

All of it works on the histogram of lengths, at most `size` numbers, so its cost does not follow the corpus.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np


def patterns(size: int) -> np.ndarray:
    """All patterns of two or three lengths that fill `size` exactly, one in each row; 0 stands for no document."""
    rows = [np.stack([np.zeros(size // 2, np.int64), np.arange(1, size // 2 + 1), size - np.arange(1, size // 2 + 1)], 1)]
    for a in range(1, size // 3 + 1):
        b = np.arange(a, (size - a) // 2 + 1)
        rows.append(np.stack([np.full(len(b), a), b, size - a - b], 1))
    return np.concatenate(rows)


def repeat_counts(histogram: np.ndarray, pats: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|^2, A's columns being the patterns' length counts.

    Projected gradient steps with momentum; a column has at most three entries, so a step costs a gather and a count.
    """
    present = (histogram[pats] > 0) | (pats == 0)
    use = np.flatnonzero(present.all(1))
    x = np.zeros(len(pats))
    if not len(use):
        return x
    p, size = pats[use], len(histogram)
    fill = lambda v: sum(np.bincount(p[:, j], v, size) for j in range(3))
    real = p > 0

    def back(r: np.ndarray) -> np.ndarray:
        return (r[p] * real).sum(1)

    v = np.ones(len(use))
    for _ in range(30):  # the largest eigenvalue of A'A, by power iteration
        r = fill(v)
        r[0] = 0
        v = back(r)
        top = np.linalg.norm(v)
        v /= top
    y = z = np.zeros(len(use))
    momentum = 1.0
    for _ in range(rounds):
        r = fill(z) - histogram
        r[0] = 0
        new = np.maximum(0, z - back(r) / (1.05 * top))
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z = new + (momentum - 1) / nxt * (new - y)
        y, momentum = new, nxt
    x[use] = y
    return x


def plan(histogram: np.ndarray, size: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Where the documents of each length go: (length, how many, first sequence, offset), in rank order; and the number of sequences.

    Counts are rounded down, then the largest fractions up, never beyond the documents there are; what is left is
    packed best-fit, longest first, on the histogram too. An entry places `how many` documents of a length, one
    in each sequence from `first sequence` on, all at `offset`.
    """
    left = histogram.astype(np.int64).copy()
    pats = patterns(size)
    x = repeat_counts(left.astype(float), pats)
    taken = np.zeros(len(pats), np.int64)
    for step in (np.floor(x + 1e-9).astype(np.int64), None):
        wants = step if step is not None else np.ones(len(pats), np.int64)
        rank = x if step is not None else x - np.floor(x + 1e-9)
        order = np.argsort(-rank, kind="stable")
        for k in order[(wants[order] > 0) & (rank[order] > (0 if step is not None else 1e-6))].tolist():
            a, b, c = pats[k].tolist()
            n = int(wants[k])
            for length, often in {a: (a == b) + (a == c) + 1, b: (a == b) + (b == c) + 1, c: (a == c) + (b == c) + 1}.items():
                n = min(n, int(left[length]) // often) if length else n
            if n > 0:
                taken[k] += n
                for length in (a, b, c):
                    if length:
                        left[length] -= n
    out: list[tuple[int, int, int, int]] = []
    base = 0
    for k in np.flatnonzero(taken).tolist():
        offset = 0
        for length in pats[k].tolist():
            if length:
                out.append((length, int(taken[k]), base, offset))
                offset += length
        base += int(taken[k])

    groups: dict[int, list[tuple[int, int]]] = {}  # free space -> runs of open sequences (first, how many)
    spaces: list[int] = []

    def put(space: int, first: int, many: int) -> None:
        if space > 0 and many:
            if space not in groups:
                insort(spaces, space)
            groups.setdefault(space, []).append((first, many))

    for length in range(size - 1, 0, -1):
        c = int(left[length])
        while c:
            i = bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, many = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    spaces.pop(i)
                k = min(c, many)
                out.append((length, k, first, size - space))
                put(space - length, first, k)
                put(space, first + k, many - k)
                c -= k
            else:  # new sequences, each filled with as many of this length as fit
                each = min(c, size // length)
                k = c // each
                for j in range(each):
                    out.append((length, k, base, j * length))
                put(size - each * length, base, k)
                base += k
                c -= each * k
    return out, base


def intervals(entries: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries as a lookup: sorted keys length << 40 | first rank, and what a rank adds to: first sequence, offset."""
    at: dict[int, int] = {}
    rows = []
    for length, many, first, offset in entries:
        rank = at.get(length, 0)
        rows.append((length << 40 | rank, first - rank, offset))
        at[length] = rank + many
    rows.sort()
    return tuple(np.array([r[j] for r in rows], np.int64) for j in range(3))  # type: ignore[return-value]


