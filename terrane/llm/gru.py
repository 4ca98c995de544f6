"""A gated recurrent language model in numpy: truncated backpropagation through time and a class-factored softmax.

Words of a short list belong to one class each and are told apart by a softmax inside it; all other words belong to tail classes, inside
which the caller supplies fixed probabilities. Inputs are word numbers: 0 to n_words - 1 for the short list, then one number for each
tail class. The state starts at zero with every document, whose first input is the end token.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

F32 = np.float32
#: Rows of the class layer, weights of Adam and documents of a score that are held at once; they stay in a processor's cache.
TILE, BLOCK, SLAB = 256, 16384, 512


@dataclass
class Weights:
    """Input table (biases included), recurrent matrix, class layer and word layer."""

    e: np.ndarray
    u: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    ww: np.ndarray
    bw: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> bytes:
        return np.concatenate([a.ravel() for a in self.arrays()]).astype(F32).tobytes()

    def filled(self, data: np.ndarray) -> Weights:
        """Weights of these shapes as views of the data."""
        out, at = [], 0
        for a in self.arrays():
            out.append(data[at : at + a.size].reshape(a.shape).astype(F32, copy=False))
            at += a.size
        return Weights(*out)


@dataclass
class Layout:
    """bounds: where the short list's classes begin in the word numbers, with its length at the end; classes of tails follow theirs."""

    bounds: np.ndarray
    n_tails: int
    end: int

    @property
    def n_words(self) -> int:
        return int(self.bounds[-1])

    @property
    def n_heads(self) -> int:
        return len(self.bounds) - 1

    def classes(self, words: np.ndarray) -> np.ndarray:
        head = np.searchsorted(self.bounds, words, side="right") - 1
        return np.where(words < self.n_words, head, words - self.n_words + self.n_heads)


def start(layout: Layout, class_mass: np.ndarray, word_mass: np.ndarray, hidden: int, seed: int = 3) -> Weights:
    """Small random weights whose output biases are the logs of the training frequencies."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, s: rng.normal(0, s, shape).astype(F32)
    n_in, n_class = layout.n_words + layout.n_tails, layout.n_heads + layout.n_tails
    return Weights(draw(n_in, 3 * hidden, s=0.1), draw(hidden, 3 * hidden, s=hidden**-0.5), draw(hidden, n_class, s=0.05), np.log(class_mass).astype(F32), draw(layout.n_words, hidden, s=0.05), np.log(word_mass).astype(F32))


class Cell:
    """The recurrent weights as a step takes them: a table and a matrix for each gate, so that all its arrays are contiguous; halved for
    the sigmoids, which are computed by tanh: numpy does that in one vectorised pass."""

    def __init__(self, w: Weights):
        n = w.u.shape[0]
        factor = np.array([0.5, 0.5, 1], F32)[:, None, None]
        self.e, self.u = (factor * np.ascontiguousarray(a.reshape(-1, 3, n).transpose(1, 0, 2)) for a in (w.e, w.u))

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step for all lanes; gives the new state, the gates z, r and c, and what r is multiplied with."""
        a, v = self.e.take(x, axis=1), np.matmul(h, self.u)
        gates = a[:2]
        gates += v[:2]
        np.tanh(gates, out=gates)
        gates *= F32(0.5)
        gates += F32(0.5)
        z, r = gates
        c = r * v[2]
        c += a[2]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        return new, z, r, c, v[2]


def step(w: Weights, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of a cell with these weights."""
    return Cell(w).step(x, h)


def _with_ones(a: np.ndarray) -> np.ndarray:
    """With a last column of ones: biases and sums of rows then come out of the products."""
    out = np.ones((a.shape[0], a.shape[1] + 1), F32)
    out[:, :-1] = a
    return out


def _small(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no logit of states between -1 and 1 can overflow, so that none need be taken off before exp."""
    return float(np.abs(weights).sum(axis=0).max(initial=0.0) + np.abs(bias).max(initial=0.0)) < 80


def _exp(s: np.ndarray, small: bool) -> np.ndarray:
    """exp of the logits, in place."""
    if not small:
        s -= s.max(axis=1, keepdims=True)
    return np.exp(s, out=s)


def _sorted(numbers: np.ndarray, most: int) -> np.ndarray:
    """Stable order of numbers below `most`; 16-bit numbers are sorted by radix."""
    return np.argsort(numbers.astype(np.uint16) if most <= 1 << 16 else numbers, kind="stable")


def _chosen(s: np.ndarray, at: np.ndarray, small: bool) -> np.ndarray:
    """Log softmax at one place of each row; a product with ones sums rows faster than a reduction."""
    if not small:
        s -= s.max(axis=1, keepdims=True)
    own = s.ravel()[np.arange(0, s.size, s.shape[1]) + at].astype(np.float64)
    return own - np.log(_exp(s, True) @ np.ones(s.shape[1], F32))


def _by_class(layout: Layout, kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, slice]]]:
    """Rows whose words are of the short list, by class, and (class bounds, where in these rows) of its classes that occur."""
    order = _sorted(kind, layout.n_heads + layout.n_tails)
    cuts = np.searchsorted(kind[order], np.arange(layout.n_heads + 1)).tolist()
    bounds = layout.bounds.tolist()
    return order[: cuts[-1]], [(a, b, slice(i, j)) for a, b, i, j in zip(bounds, bounds[1:], cuts, cuts[1:]) if i < j and b - a > 1]


def log_probabilities(w: Weights, layout: Layout, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logs: of the word for words of the short list, of the class for tails."""
    kind, states = layout.classes(targets), _with_ones(states)
    out, small, wc = np.empty(len(targets)), _small(w.wc, w.bc), np.vstack([w.wc, w.bc])
    for at in range(0, len(targets), TILE):
        part = slice(at, at + TILE)
        out[part] = _chosen(states[part] @ wc, kind[part], small)
    small, ww = _small(w.ww.T, w.bw), np.column_stack([w.ww, w.bw])
    order, spans = _by_class(layout, kind)
    states, targets, inner = states.take(order, axis=0), targets[order], np.zeros(len(order))
    for a, b, part in spans:
        inner[part] = _chosen(states[part] @ ww[a:b].T, targets[part] - a, small)
    out[order] += inner
    return out


def _loss(own: np.ndarray, w: np.ndarray, w_ones: np.ndarray, target: np.ndarray, small: bool, scale: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a softmax over the rows of w (biases last) at the states own (ones last): of w and of the states."""
    p = _exp(own @ w.T, small)
    back = p @ w_ones  # the last column is the sum of a row
    total = back[:, -1].copy()
    p.ravel()[np.arange(0, p.size, p.shape[1]) + target] -= total
    by = (scale / total)[:, None]
    back *= by
    back -= scale * w_ones.take(target, axis=0)
    return p.T @ (own * by), back[:, :-1]


def _summed(rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows by id; those of frequent ids as products with ones, which are faster than a reduction."""
    out, order = np.zeros((n, rows.shape[1]), F32), _sorted(ids, n)
    ids, rows = ids[order], rows.take(order, axis=0)
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    sizes = np.diff(first, append=len(ids))
    many, one = sizes >= 16, np.ones(sizes.max(), F32)
    for a, k in zip(first[many].tolist(), sizes[many].tolist()):
        out[ids[a]] = one[:k] @ rows[a : a + k]
    if not many.all():
        few = sizes[~many]
        out[ids[first[~many]]] = np.add.reduceat(rows[np.repeat(~many, sizes)], np.cumsum(few) - few)
    return out


def _gradients(w: Weights, layout: Layout, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of a window (steps, lanes) of inputs x and targets y that starts in state h, and the state behind it."""
    steps, lanes = x.shape
    n = h.shape[1]
    cell, begun = Cell(w), (x != layout.end).astype(F32)[:, :, None]
    fresh, gates, states = np.empty((steps, lanes, n), F32), [], np.ones((steps, lanes, n + 1), F32)
    for t in range(steps):
        np.multiply(h, begun[t], out=fresh[t])  # a document starts from the zero state
        h, *kept = cell.step(x[t], fresh[t])
        gates.append(kept)
        states[t, :, :n] = h
    flat, target = states.reshape(-1, n + 1), y.ravel()
    kind = layout.classes(target)
    scale = F32(1 / len(target))
    g, ds = [np.zeros_like(a) for a in w.arrays()], np.empty((len(flat), n), F32)
    small, wc, ones = _small(w.wc, w.bc), np.vstack([w.wc, w.bc]).T, _with_ones(w.wc.T)
    for at in range(0, len(flat), TILE):
        part = slice(at, at + TILE)
        d, ds[part] = _loss(flat[part], wc, ones, kind[part], small, scale)
        g[2] += d[:, :-1].T
        g[3] += d[:, -1]
    small, ww, ones = _small(w.ww.T, w.bw), np.column_stack([w.ww, w.bw]), _with_ones(w.ww)
    order, spans = _by_class(layout, kind)
    own, target, inner = flat.take(order, axis=0), target[order], np.zeros((len(order), n), F32)
    for a, b, part in spans:
        d, inner[part] = _loss(own[part], ww[a:b], ones[a:b], target[part] - a, small, scale)
        g[4][a:b], g[5][a:b] = d[:, :-1], d[:, -1]
    ds[order] += inner
    ds = ds.reshape(steps, lanes, n)
    back_u = np.ascontiguousarray(w.u.reshape(n, 3, n).transpose(1, 2, 0))
    da, dv = np.empty((steps, lanes, 3, n), F32), np.empty((steps, 3, lanes, n), F32)
    carry = np.zeros((lanes, n), F32)
    for t in range(steps - 1, -1, -1):
        z, r, c, v = gates.pop()
        carry += ds[t]
        rest = 1 - z
        dc = c * c
        np.subtract(F32(1), dc, out=dc)
        dc *= rest
        dc *= carry
        dz, dr, dn = dv[t]
        np.subtract(fresh[t], c, out=dz)
        carry *= z
        dz *= rest
        dz *= carry
        np.multiply(dc, r, out=dn)
        np.subtract(F32(1), r, out=dr)
        dr *= dn
        dr *= v
        da[t, :, 0], da[t, :, 1], da[t, :, 2] = dz, dr, dc
        for d in np.matmul(dv[t], back_u):
            carry += d
        carry *= begun[t]
    for t in range(steps):
        g[1].reshape(n, 3, n)[:] += np.matmul(fresh[t].T, dv[t]).transpose(1, 0, 2)
    g[0] = _summed(da.reshape(-1, 3 * n), x.ravel(), len(w.e))
    return g, h


class Trainer:
    """Adam over windows of a stream cut into lanes; the state is carried from window to window."""

    def __init__(self, weights: Weights, layout: Layout, rate: float, lanes: int = 64, window: int = 24):
        """The weights given stay as they are."""
        self.flat = np.frombuffer(weights.flat(), F32).copy()
        self.w, self.layout, self.rate, self.lanes, self.window = weights.filled(self.flat), layout, rate, lanes, window
        self.m, self.v, self.t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def learn(self, stream: np.ndarray, fade: tuple[float, float] = (1.0, 1.0)) -> int:
        """One pass over a stream of documents, each with its end. fade: factors of the rate at the start and the end.

        Lanes may overlap by a few tokens, so that they take in the whole stream.
        """
        lanes = min(self.lanes, max(1, len(stream) // (2 * self.window)))
        n = -(-len(stream) // lanes)
        if n < 1:
            return 0
        begins, before = np.arange(lanes) * (len(stream) - n) // max(1, lanes - 1), np.full((1, lanes), self.layout.end)
        h = np.zeros((lanes, self.w.u.shape[0]), F32)
        for at in range(0, n, self.window):
            y = stream[np.arange(at, min(n, at + self.window))[:, None] + begins].astype(np.int64)
            g, h = _gradients(self.w, self.layout, np.vstack([before, y[:-1]]), y, h)
            before = y[-1:]
            self._moved(np.concatenate([a.ravel() for a in g]), self.rate * (fade[0] + (fade[1] - fade[0]) * at / n))
        return len(stream)

    def _moved(self, g: np.ndarray, rate: float) -> None:
        """A step of Adam along the gradients, which are used up."""
        clip = min(1.0, 1.0 / max(float(np.sqrt(g @ g)), 1e-12))
        self.t += 1
        lr = F32(rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for at in range(0, len(g), BLOCK):
            a, m, v, d = (b[at : at + BLOCK] for b in (self.flat, self.m, self.v, g))
            d *= F32(clip)
            s = d * d
            s -= v
            s *= F32(0.001)
            v += s
            d -= m
            d *= F32(0.1)
            m += d
            np.sqrt(v, out=s)
            s += F32(1e-8)
            np.divide(m, s, out=s)
            s *= lr
            a -= s


def score_documents(w: Weights, layout: Layout, stream: np.ndarray, lengths: np.ndarray, window: int = 48) -> np.ndarray:
    """Natural log of each target's probability (see log_probabilities) at its place in the stream of documents.

    Documents of like length go forward together, longest first, with their states carried over all windows to their ends.
    """
    order, out, cell = np.argsort(-lengths, kind="stable"), np.zeros(len(stream)), Cell(w)
    for some in np.split(order, range(SLAB, len(order), SLAB)):
        begins, sizes = (np.cumsum(lengths) - lengths)[some], lengths[some]
        h = np.zeros((len(sizes), w.u.shape[0]), F32)
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        states, places = [], []
        for t in range(longest):
            n = active[t]
            at = begins[:n] + t
            x = stream[at - 1] if t else np.full(n, layout.end)
            h = cell.step(x, h[:n])[0]
            states.append(h)
            places.append(at)
            if (t + 1) % window == 0 or t == longest - 1:
                at = np.concatenate(places)
                out[at] = log_probabilities(w, layout, np.concatenate(states), stream[at].astype(np.int64))
                states, places = [], []
    return out
