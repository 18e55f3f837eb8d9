"""A gated recurrent language model with a class-factored softmax, in numpy.

Words are numbered by falling count; word w is in class w // width, so P(word | state) is P(class | state) times
P(word | class, state). Output weights start at zero and biases at the words' counts, so an untrained model is the
unigram distribution. Training is truncated backpropagation with Adam over streams of texts that run side by side; the
state starts anew at each text and is carried across windows, in training and in scoring, so a score is the
log-likelihood of a complete text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Params = dict[str, np.ndarray]


@dataclass(frozen=True)
class Shape:
    """Fixed sizes and rates; none of them follows the corpus.

    `batch` streams run side by side, fewer where a share of texts is so small that it would have under `updates` windows.
    """

    classes: int = 32
    width: int = 32
    hidden: int = 20
    window: int = 32
    batch: int = 128
    updates: int = 64
    rate: float = 0.02
    seed: int = 3

    @property
    def words(self) -> int:
        return self.classes * self.width


def initial(counts: np.ndarray, shape: Shape) -> Params:
    """A model for words with these counts (half a count is added to each)."""
    h, rng = shape.hidden, np.random.default_rng(shape.seed)
    c = counts.astype(float).reshape(shape.classes, shape.width) + 0.5
    p = {
        "x": rng.normal(0, 0.3, (shape.words, 3 * h)), "h": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)), "b": np.zeros(3 * h),
        "cw": np.zeros((h, shape.classes)), "cb": np.log(c.sum(1) / c.sum()),
        "ww": np.zeros((shape.classes, h, shape.width)), "wb": np.log(c / c.sum(1, keepdims=True)),
    }
    p["b"][:h] = 1.0  # the gates begin by keeping
    return {k: v.astype(np.float32) for k, v in p.items()}


def _step(x: np.ndarray, h: np.ndarray, recurrent: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One step: (new state, the state's part of the candidate). The rows `x` become the gates z, r and the candidate n."""
    u = h @ recurrent
    g = x[:, : 2 * size]
    g += u[:, : 2 * size]
    g *= 0.5  # the logistic function by tanh
    np.tanh(g, out=g)
    g *= 0.5
    g += 0.5
    un, n = u[:, 2 * size :], x[:, 2 * size :]
    n += g[:, size:] * un
    np.tanh(n, out=n)
    new = h - n
    new *= g[:, :size]
    new += n
    return new, un


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, logarithms of the sums) of columns; logits are shifted in place by their maxima."""
    logits -= logits.max(0)
    e = np.exp(logits)
    total = e.sum(0)
    e /= total
    return e, np.log(total)


def _by_class(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(classes, kind="stable")
    names, first = np.unique(classes[order], return_index=True)
    return order, names, np.append(first, len(classes))


def _word_log_p(p: Params, states: np.ndarray, words: np.ndarray, shape: Shape) -> np.ndarray:
    """Natural log-probability of each word after each state (a row of `states`)."""
    order, names, edge = _by_class(words // shape.width)
    s = np.ascontiguousarray(states[order].T)
    c, w = np.divmod(words[order], shape.width)
    every = np.arange(len(words))
    logits = p["cw"].T @ s + p["cb"][:, None]
    logits -= logits.max(0)
    out = (logits[c, every] - np.log(np.exp(logits).sum(0))).astype(np.float64)
    for i, k in enumerate(names.tolist()):
        a, z = edge[i], edge[i + 1]
        logits = p["ww"][k].T @ s[:, a:z] + p["wb"][k][:, None]
        logits -= logits.max(0)
        out[a:z] += logits[w[a:z], every[: z - a]] - np.log(np.exp(logits).sum(0))
    back = np.empty(len(words))
    back[order] = out
    return back


def score(p: Params, words: np.ndarray, first: np.ndarray, start: int, shape: Shape, group: int = 1024) -> np.ndarray:
    """Natural log-likelihood of each text; text i is words[first[i]:first[i + 1]], and `start` stands before it.

    Texts go through the model side by side, longest first; a text that ends leaves the row.
    """
    length = np.diff(first)
    out = np.zeros(len(length))
    order = np.argsort(-length, kind="stable")
    table = p["x"] + p["b"]
    for a in range(0, len(order), group):
        mine = order[a : a + group]
        size = length[mine]
        begin = first[mine]
        h = np.zeros((len(mine), shape.hidden), np.float32)
        before = np.full(len(mine), start)
        t, top = 0, int(size[0])
        while t < top:
            live = int((size > t).sum())
            # as many steps at once as keep the window's states small
            stop = min(t + max(shape.window, 16384 // live), top)
            states, targets, of = [], [], []
            while t < stop:
                live = int(np.searchsorted(-size, -t, "left"))
                h, before = h[:live], before[:live]
                h = _step(table[before], h, p["h"], shape.hidden)[0]
                before = words[begin[:live] + t]
                states.append(h)
                targets.append(before)
                of.append(live)
                t += 1
            got = _word_log_p(p, np.concatenate(states), np.concatenate(targets), shape)
            out[mine[: of[0]]] += np.bincount(np.concatenate([np.arange(k) for k in of]), got, of[0])
    return out


def _window(p: Params, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, keep: np.ndarray, h: np.ndarray, shape: Shape) -> tuple[Params, np.ndarray, np.ndarray]:
    """Gradients of a window's mean loss (steps by streams), the rows of `x` they touch, and the state after it.

    `keep` is 0 where a text begins, so that the state before it is forgotten, else 1.
    """
    size, (steps, many) = shape.hidden, inputs.shape
    g = {}
    pre = p["x"][inputs] + p["b"]
    into, states, own = (np.empty((steps, many, size), pre.dtype) for _ in range(3))
    begins = ~keep.all(1)
    for t in range(steps):
        into[t] = h * keep[t][:, None] if begins[t] else h
        h, own[t] = _step(pre[t], into[t], p["h"], size)
        states[t] = h
    # the outputs, with the states in the order of the targets' classes, one column each
    flat = targets.reshape(-1)
    order, names, edge = _by_class(flat // shape.width)
    c, w = np.divmod(flat[order], shape.width)
    s = np.ascontiguousarray(states.reshape(-1, size)[order].T)
    weight = (real.reshape(-1)[order] / max(1, real.sum())).astype(pre.dtype)
    every = np.arange(len(flat))
    d, _ = _softmax(p["cw"].T @ s + p["cb"][:, None])
    d[c, every] -= 1
    d *= weight
    g["cw"], g["cb"] = s @ d.T, d.sum(1)
    ds = p["cw"] @ d
    g["ww"], g["wb"] = np.zeros_like(p["ww"]), np.zeros_like(p["wb"])
    for i, k in enumerate(names.tolist()):
        a, z = edge[i], edge[i + 1]
        d, _ = _softmax(p["ww"][k].T @ s[:, a:z] + p["wb"][k][:, None])
        d[w[a:z], every[: z - a]] -= 1
        d *= weight[a:z]
        g["ww"][k], g["wb"][k] = s[:, a:z] @ d.T, d.sum(1)
        ds[:, a:z] += p["ww"][k] @ d
    back = np.empty((len(flat), size), pre.dtype)
    back[order] = ds.T
    back = back.reshape(steps, many, size)
    # back through the steps; what does not depend on what comes from later steps is computed for all at once
    z, r, n = pre[..., :size], pre[..., size : 2 * size], pre[..., 2 * size :]
    by_n, by_z, by_r = (1 - z) * (1 - n * n), (into - n) * z * (1 - z), own * r * (1 - r)
    dx, du = np.empty_like(pre), np.empty_like(pre)
    recurrent = np.ascontiguousarray(p["h"].T)
    dh = np.zeros((many, size), pre.dtype)
    for t in range(steps - 1, -1, -1):
        dh += back[t]
        x = dx[t]
        dn = np.multiply(dh, by_n[t], out=x[:, 2 * size :])
        np.multiply(dh, by_z[t], out=x[:, :size])
        np.multiply(dn, by_r[t], out=x[:, size : 2 * size])
        u = du[t]
        u[:, : 2 * size] = x[:, : 2 * size]
        np.multiply(dn, r[t], out=u[:, 2 * size :])
        dh *= z[t]
        dh += u @ recurrent
        if begins[t]:
            dh *= keep[t][:, None]
    g["h"] = into.reshape(-1, size).T @ du.reshape(-1, 3 * size)
    dx = dx.reshape(-1, 3 * size)
    g["b"] = dx.sum(0)
    order = np.argsort(inputs.reshape(-1), kind="stable")
    rows, first = np.unique(inputs.reshape(-1)[order], return_index=True)
    g["x"] = np.add.reduceat(dx[order], first, axis=0)
    return g, rows, h


def train(p: Params, texts: list[np.ndarray], start: int, shape: Shape) -> Params:
    """The model after one pass over the texts (arrays of word numbers), end to end in their order, dealt to streams."""
    p = {k: v.copy() for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    texts = [t for t in texts if len(t)]
    if not texts:
        return p
    targets = np.concatenate(texts)
    total = len(targets)
    inputs = np.concatenate([[start], targets[:-1]])
    keep = np.ones(total, np.float32)
    begins = np.cumsum([0, *map(len, texts[:-1])])
    inputs[begins], keep[begins] = start, 0
    many = max(1, min(shape.batch, total // (shape.window * shape.updates)))
    long = -(-total // many)
    real = np.ones(total, bool)
    fit = lambda x: np.ascontiguousarray(np.concatenate([x, np.zeros(many * long - total, x.dtype)]).reshape(many, long).T)
    inputs, targets, keep, real = map(fit, (inputs, targets, keep, real))
    keep[0] = 0
    h = np.zeros((many, shape.hidden), np.float32)
    turn = 0
    for a in range(0, long, shape.window):
        cut = slice(a, a + shape.window)
        g, rows, h = _window(p, inputs[cut], targets[cut], real[cut], keep[cut], h, shape)
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        turn += 1
        rate = shape.rate * np.sqrt(1 - 0.999**turn) / (1 - 0.9**turn) * min(1.0, 1.0 / max(norm, 1e-9))
        for k, x in g.items():
            at = rows if k == "x" else slice(None)
            m[k][at] = 0.9 * m[k][at] + 0.1 * x
            v2[k][at] = 0.999 * v2[k][at] + 0.001 * x * x
            p[k][at] -= rate * m[k][at] / (np.sqrt(v2[k][at]) + 1e-6)
    return p
