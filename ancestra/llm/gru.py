"""A gated recurrent language model with a class-factored softmax, in numpy.

Symbols are the words of a vocabulary, in order of their class, and behind them `n_open` open classes: of a word
outside the vocabulary the model gives the probability of its open class alone. P(word) = P(class) P(word | class).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EMBED, HIDDEN, WINDOW = 16, 24, 24
#: Texts that are read side by side: as many as leave UPDATES steps of the optimiser, within these bounds.
LEAST_LANES, MOST_LANES, UPDATES = 8, 256, 100
#: Symbols that training reads of a text with one state; the next ones go to another lane, so lanes are equally full.
SPAN = 512


@dataclass(frozen=True)
class Shape:
    """bounds: where each class of words begins among them, and their number; n_open: open classes; end: the symbol that ends a text."""

    bounds: tuple[int, ...]
    n_open: int
    end: int

    @property
    def words(self) -> int:
        return self.bounds[-1]

    @property
    def classes(self) -> int:
        return len(self.bounds) - 1 + self.n_open

    def parts(self) -> dict[str, tuple[int, ...]]:
        h, k = HIDDEN, self.words
        return {"e": (k + self.n_open, EMBED), "w": (EMBED, 3 * h), "u": (h, 3 * h), "b": (3 * h,), "oc": (h, self.classes), "bc": (self.classes,), "ow": (h, k), "bw": (k,)}

    def class_of(self) -> np.ndarray:
        sizes = np.diff(self.bounds)
        return np.concatenate((np.repeat(np.arange(len(sizes)), sizes), len(sizes) + np.arange(self.n_open)))


def initial(shape: Shape, counts: np.ndarray, seed: int = 1) -> np.ndarray:
    """Small random weights, and biases by which the model gives each symbol (of `counts`) its share, whatever came before."""
    rng = np.random.default_rng(seed)
    p = {k: rng.standard_normal(s) * (0.1 if k == "e" else 0.1 / np.sqrt(s[0]) if k in ("oc", "ow") else 1 / np.sqrt(s[0])) if len(s) == 2 else np.zeros(s) for k, s in shape.parts().items()}
    class_of = shape.class_of()
    of_class = np.bincount(class_of, counts + 0.5, shape.classes)
    p["bc"] = np.log(of_class / of_class.sum())
    p["bw"] = np.log((counts + 0.5) / of_class[class_of])[: shape.words]
    return np.concatenate([x.ravel() for x in p.values()]).astype(np.float32)


def views(shape: Shape, flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shape.parts().items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def lanes(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Texts dealt out to lanes of about equal length, longest first."""
    import heapq

    heap = [(0, i) for i in range(width)]
    out: list[list[int]] = [[] for _ in range(width)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (n + int(lengths[d]), i))
    return out


def streams(symbols: np.ndarray, starts: np.ndarray, width: int, end: int, first: np.ndarray | None = None):
    """Of texts symbols[starts[d]:starts[d + 1]]: inputs, targets, text numbers (-1: none) and whether a text begins, each [steps, lanes].

    first: the symbol before each text, where it isn't `end`."""
    lengths = np.diff(starts)
    dealt = [x for x in lanes(lengths, min(width, max(1, len(lengths)))) if x]
    steps = max(int(lengths[x].sum()) for x in dealt)
    target = np.zeros((len(dealt), steps), np.int32)
    text = np.full((len(dealt), steps), -1, np.int32)
    for i, own in enumerate(dealt):
        at = 0
        for d in own:
            n = int(lengths[d])
            target[i, at : at + n] = symbols[starts[d] : starts[d + 1]]
            text[i, at : at + n] = d
            at += n
    begin = np.ones_like(text, bool)
    begin[:, 1:] = text[:, 1:] != text[:, :-1]
    source = np.full_like(target, end)
    source[:, 1:] = target[:, :-1]
    source[begin] = end if first is None else np.where(text[begin] < 0, end, first[text[begin]])
    return (np.ascontiguousarray(x.T) for x in (source, target, text, begin))


def _outputs(p: dict, shape: Shape, h: np.ndarray, target: np.ndarray, class_of: np.ndarray, back: dict | None):
    """Log-probabilities of the targets; with back: gradients of their negated mean go there, and that by h is returned."""
    c = class_of[target]
    logits = h @ p["oc"] + p["bc"]
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    total = logits.sum(1, keepdims=True)
    logits /= total
    n = len(target)
    found = np.log(logits[np.arange(n), c])
    dh = None
    if back is not None:
        logits[np.arange(n), c] -= 1
        logits /= n
        back["oc"] += h.T @ logits
        back["bc"] += logits.sum(0)
        dh = logits @ p["oc"].T
    order = np.argsort(c, kind="stable")
    edges = np.searchsorted(c[order], np.arange(len(shape.bounds)))
    for k, (a, b) in enumerate(zip(shape.bounds, shape.bounds[1:])):
        rows = order[edges[k] : edges[k + 1]]
        if len(rows) and b - a > 1:
            own = h[rows]
            x = own @ p["ow"][:, a:b] + p["bw"][a:b]
            x -= x.max(1, keepdims=True)
            np.exp(x, out=x)
            x /= x.sum(1, keepdims=True)
            at = target[rows] - a
            found[rows] += np.log(x[np.arange(len(rows)), at])
            if back is not None:
                x[np.arange(len(rows)), at] -= 1
                x /= n
                back["ow"][:, a:b] += own.T @ x
                back["bw"][a:b] += x.sum(0)
                dh[rows] += x @ p["ow"][:, a:b].T
    return found, dh


def score(shape: Shape, flat: np.ndarray, symbols: np.ndarray, starts: np.ndarray, width: int = 256, block: int = 64) -> np.ndarray:
    """Natural log-likelihood of each whole text; the state goes on from step to step and is reset where a text begins."""
    p, h3 = views(shape, flat), HIDDEN
    class_of = shape.class_of()
    table = p["e"] @ p["w"] + p["b"]
    source, target, text, begin = streams(symbols, starts, width, shape.end)
    steps, n = source.shape
    h = np.zeros((n, h3), np.float32)
    out = np.zeros(len(starts) - 1)
    for s in range(0, steps, block):
        hs = np.empty((min(block, steps - s), n, h3), np.float32)
        for t in range(len(hs)):
            h[begin[s + t]] = 0
            x = table[source[s + t]]
            u = h @ p["u"]
            g = _sigmoid(x[:, : 2 * h3] + u[:, : 2 * h3])
            new = np.tanh(x[:, 2 * h3 :] + g[:, h3:] * u[:, 2 * h3 :])
            h = new + g[:, :h3] * (h - new)
            hs[t] = h
        d = text[s : s + block].ravel()
        real = np.flatnonzero(d >= 0)
        found, _ = _outputs(p, shape, hs.reshape(-1, h3)[real], target[s : s + block].ravel()[real], class_of, None)
        out += np.bincount(d[real], found, len(out))
    return out


def gradient(shape: Shape, flat: np.ndarray, h: np.ndarray, source: np.ndarray, target: np.ndarray, real: np.ndarray, begin: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of a window [steps, lanes] that starts with state h: mean negative log-likelihood of the real targets, its gradient
    (none goes back beyond the window), and the state after it."""
    p, hid, (size, n) = views(shape, flat), HIDDEN, source.shape
    table = p["e"] @ p["w"] + p["b"]
    go = (~begin).astype(flat.dtype)[:, :, None]
    x = table[source]
    before, zr, un, new, hs = (np.empty((size, n, k * hid), flat.dtype) for k in (1, 2, 1, 1, 1))
    for t in range(size):
        h = h * go[t]
        u = h @ p["u"]
        g = _sigmoid(x[t, :, : 2 * hid] + u[:, : 2 * hid])
        before[t], zr[t], un[t] = h, g, u[:, 2 * hid :]
        new[t] = np.tanh(x[t, :, 2 * hid :] + g[:, hid:] * un[t])
        h = hs[t] = new[t] + g[:, :hid] * (h - new[t])
    out = np.zeros_like(flat)
    back = views(shape, out)
    real = np.flatnonzero(real.ravel())
    found, dh_real = _outputs(p, shape, hs.reshape(-1, hid)[real], target.ravel()[real], shape.class_of(), back)
    dhs = np.zeros((size * n, hid), flat.dtype)
    dhs[real] = dh_real
    dhs = dhs.reshape(size, n, hid)
    # what doesn't depend on the way back is worked out for all steps at once
    z, r = zr[:, :, :hid], zr[:, :, hid:]
    by_new = (1 - z) * (1 - new * new)
    by_z = (before - new) * z * (1 - z)
    by_r = un * r * (1 - r)
    dx = np.empty((size, n, 3 * hid), flat.dtype)
    du = np.empty_like(dx)
    ut = np.ascontiguousarray(p["u"].T)
    dh = np.zeros((n, hid), flat.dtype)
    for t in reversed(range(size)):
        dh += dhs[t]
        dn = dh * by_new[t]
        dx[t, :, :hid] = dh * by_z[t]
        dx[t, :, hid : 2 * hid] = dn * by_r[t]
        dx[t, :, 2 * hid :] = dn
        du[t, :, : 2 * hid] = dx[t, :, : 2 * hid]
        du[t, :, 2 * hid :] = dn * r[t]
        dh = (dh * z[t] + du[t] @ ut) * go[t]
    back["u"] += before.reshape(-1, hid).T @ du.reshape(-1, 3 * hid)
    flow = dx.reshape(-1, 3 * hid)
    back["b"] += flow.sum(0)
    order = np.argsort(source.ravel(), kind="stable")
    own = source.ravel()[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    by_symbol, symbols = np.add.reduceat(flow[order], first), own[first]
    back["w"] += p["e"][symbols].T @ by_symbol
    back["e"][symbols] += by_symbol @ p["w"].T
    return -float(found.mean()), out, h


def train(shape: Shape, flat: np.ndarray, symbols: np.ndarray, starts: np.ndarray, rate: float, passes: int = 1) -> np.ndarray:
    """Parameters after truncated backpropagation through windows of WINDOW steps, the state carried on for SPAN symbols; Adam."""
    flat = flat.copy()
    if len(starts) < 2:
        return flat
    lanes_ = min(MOST_LANES, max(LEAST_LANES, len(symbols) // (WINDOW * UPDATES)))
    parts = -(-np.diff(starts) // SPAN)
    of = np.repeat(np.arange(len(parts)), parts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = starts[of] + k * SPAN
    first = np.where(k > 0, symbols[np.maximum(cuts - 1, 0)], shape.end)
    source, target, text, begin = streams(symbols, np.append(cuts, starts[-1]), lanes_, shape.end, first)
    steps, n = source.shape
    m, v, round_ = np.zeros_like(flat), np.zeros_like(flat), 0
    for _ in range(passes):
        h = np.zeros((n, HIDDEN), flat.dtype)
        for s in range(0, steps, WINDOW):
            w = slice(s, s + WINDOW)
            real = text[w] >= 0
            if not real.any():
                continue
            _, found, h = gradient(shape, flat, h, source[w], target[w], real, begin[w])
            norm = np.sqrt((found * found).sum())
            if norm > 1:
                found /= norm
            round_ += 1
            m += 0.1 * (found - m)
            v += 0.005 * (found * found - v)
            # windows in which few lanes still have text count for as little
            flat -= rate * real.mean(dtype=np.float32) * (m / (1 - 0.9**round_)) / (np.sqrt(v / (1 - 0.995**round_)) + 1e-7)
    return flat
