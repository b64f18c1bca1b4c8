"""Gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, state carried across windows."""

from __future__ import annotations

import heapq

import numpy as np

STATE, CLASS_WORDS, CLASSES = 16, 32, 32
#: Words with an output of their own; all others share the class of rare words.
FREQUENT = CLASS_WORDS * CLASSES
END_CLASS, RARE_CLASS = CLASSES, CLASSES + 1
#: Input symbols beside the frequent words.
END, RARE, UNKNOWN = FREQUENT, FREQUENT + 1, FREQUENT + 2
WINDOW = 32
_F = np.float32
_ONES = np.ones(CLASSES + 2, _F)
_GATES = slice(0, 2 * STATE)
_NEW = slice(2 * STATE, 3 * STATE)


def initial(counts: np.ndarray, ends: int, rare: int, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters that start as the smoothed unigram model: counts of the frequent words by rank, of ends and of rare words."""
    rng = np.random.default_rng(seed)
    c = np.zeros(FREQUENT)
    c[: len(counts)] = counts
    of_class = np.append(c.reshape(CLASSES, CLASS_WORDS).sum(axis=1), [ends, rare])
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(_F)
    used = np.arange(FREQUENT) < max(len(counts), 1)
    with np.errstate(divide="ignore"):
        word = np.where(used, np.log(c + 1) - np.log(c.max() + 1), -30.0)
        klass = np.where(np.append(used.reshape(CLASSES, CLASS_WORDS).any(axis=1), [True, True]), np.log(of_class + 1), -30.0)
    return {
        "embed": small(FREQUENT + 3, STATE),
        "wx": small(STATE, 3 * STATE),
        "wh": small(STATE, 3 * STATE),
        "b": np.zeros(3 * STATE, _F),
        "wc": np.zeros((STATE, CLASSES + 2), _F),
        "bc": (klass - np.log(np.exp(klass).sum())).astype(_F),
        "wo": np.zeros((FREQUENT, STATE), _F),
        "bo": word.astype(_F),
    }


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def unflatten(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([x.size for x in like.values()])[:-1]
    return {k: x.reshape(like[k].shape).astype(_F) for k, x in zip(like, np.split(flat, cuts), strict=True)}


def lanes(sizes: np.ndarray, width: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lane and first step of every sequence, put into the emptiest lane in `order`, and the steps of every lane."""
    heap = [(0, k) for k in range(max(1, min(width, len(sizes))))]
    lane, start = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in order:
        full, k = heap[0]
        lane[i], start[i] = k, full
        heapq.heapreplace(heap, (full + int(sizes[i]), k))
    fill = np.zeros(len(heap), np.int64)
    for full, k in heap:
        fill[k] = full
    return lane, start, fill


class Grid:
    """Sequences of symbols laid out in lanes (the longest first unless an order is given), each read from the end symbol on.

    Lanes stand by falling length, so the lanes that still run at a step are the first ones: a step holds just their
    symbols, and a very long sequence costs its own steps only.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, width: int, order: np.ndarray | None = None):
        lane, start, fill = lanes(sizes, width, np.argsort(-sizes, kind="stable") if order is None else order)
        rank = np.empty(len(fill), np.int64)
        rank[np.argsort(-fill, kind="stable")] = np.arange(len(fill))
        lane, self.steps = rank[lane], int(fill.max())
        #: lanes that run at every step, and the place of a step's first symbol
        self.active = len(fill) - np.searchsorted(np.sort(fill), np.arange(self.steps), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        first = np.cumsum(sizes) - sizes
        step = np.arange(len(symbols)) - np.repeat(first - start, sizes)
        #: place of every symbol
        self.place = self.at[step] + np.repeat(lane, sizes)
        self.target, self.input = np.empty(len(symbols), np.int16), np.empty(len(symbols), np.int16)
        self.target[self.place] = symbols
        self.input[self.place[1:]] = symbols[:-1]
        self.input[self.place[first]] = END
        #: places at which a sequence starts, from a state of zeros
        self.fresh = np.sort(self.place[first])

    def windows(self):
        """First and last step of every window, and the slice of its symbols."""
        for a in range(0, self.steps, WINDOW):
            b = min(self.steps, a + WINDOW)
            yield a, b, slice(int(self.at[a]), int(self.at[b]))


class Run:
    """States and gates of a window, one column for each symbol; `h` is the state of the lanes before it."""

    def __init__(self, p: dict, grid: Grid, a: int, b: int, cells: slice, h: np.ndarray):
        # A gate is 1/2 + tanh(x / 2) / 2: its half is taken on the weights.
        half = np.repeat(np.array([0.5, 0.5, 1], _F), STATE)
        table = ((p["embed"] @ p["wx"] + p["b"]) * half).T.copy()
        wh = (p["wh"] * half).T.copy()
        x, n = np.take(table, grid.input[cells], axis=1), cells.stop - cells.start
        self.cuts = (grid.at[a : b + 1] - cells.start).tolist()
        fresh = grid.fresh[np.searchsorted(grid.fresh, cells.start) : np.searchsorted(grid.fresh, cells.stop)] - cells.start
        ends = np.searchsorted(fresh, self.cuts).tolist()
        self.fresh, self.ends = fresh, ends
        self.before, self.after = np.empty((STATE, n), _F), np.empty((STATE, n), _F)
        self.gates, self.new, self.past = x[_GATES], x[_NEW], np.empty((STATE, n), _F)
        for t, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            h0 = self.before[:, lo:hi]
            h0[:] = h[:, : hi - lo]
            if ends[t] < ends[t + 1]:
                self.before[:, fresh[ends[t] : ends[t + 1]]] = 0
            u = wh @ h0
            zr, c = self.gates[:, lo:hi], self.new[:, lo:hi]
            zr += u[_GATES]
            np.tanh(zr, out=zr)
            zr *= _F(0.5)
            zr += _F(0.5)
            self.past[:, lo:hi] = u[_NEW]
            c += zr[STATE:] * u[_NEW]
            np.tanh(c, out=c)
            h = self.after[:, lo:hi]
            np.subtract(h0, c, out=h)
            h *= zr[:STATE]
            h += c
        #: state of the lanes that ran at the last step
        self.state = h.copy()


def class_of(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < FREQUENT, symbols // CLASS_WORDS, np.where(symbols == END, END_CLASS, RARE_CLASS)).astype(np.uint8)


def _by_class(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[slice, slice]]]:
    """Classes of the targets, their order by class, and the slices of that order and of the words for every class of words."""
    k = class_of(targets)
    order = np.argsort(k, kind="stable")
    edges = np.searchsorted(k[order], np.arange(CLASSES + 1))
    return k[order], order, [(slice(edges[c], edges[c + 1]), slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)) for c in np.flatnonzero(np.diff(edges))]


def _logits(w: np.ndarray, b: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = w @ h
    out += b[:, None]
    return out


def _exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials in place and their sums. States are within -1..1 and weights are small, so no shift is needed."""
    np.exp(logits, out=logits)
    return logits, _ONES[: len(logits)] @ logits


def log_probs(p: dict, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target symbol from the state in its column; a rare or unknown word counts as its class."""
    k, order, classes = _by_class(targets)
    h, targets, out = np.take(h, order, axis=1), targets[order], np.empty(len(k))
    column = np.arange(len(k))
    logits = _logits(p["wc"].T, p["bc"], h)
    got = logits[k, column] - np.log(_exponentials(logits)[1])
    for at, words in classes:
        logits = _logits(p["wo"][words], p["bo"][words], h[:, at])
        got[at] += logits[targets[at] - words.start, column[: at.stop - at.start]] - np.log(_exponentials(logits)[1])
    out[order] = got
    return out


def score(p: dict, symbols: np.ndarray, sizes: np.ndarray, width: int = 1024) -> np.ndarray:
    """Natural log probability of every symbol of the sequences, the state running through each whole sequence."""
    grid = Grid(symbols, sizes, width)
    h, out = np.zeros((STATE, int(grid.active[0])), _F), np.empty(len(symbols))
    for a, b, cells in grid.windows():
        run = Run(p, grid, a, b, cells, h)
        # The state after a symbol's input predicts it: that input is the symbol before.
        out[cells] = log_probs(p, run.after, grid.target[cells])
        h = run.state
    return out[grid.place]


def gradients(p: dict, grid: Grid, a: int, b: int, cells: slice, h: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean loss over a window, backpropagated to its first step, and the state after it."""
    run = Run(p, grid, a, b, cells, h)
    g, scale = {k: np.zeros_like(v) for k, v in p.items()}, _F(1.0 / (cells.stop - cells.start))
    k, order, classes = _by_class(grid.target[cells])
    hl, target, column = np.take(run.after, order, axis=1), grid.target[cells][order], np.arange(len(k))
    probs, total = _exponentials(_logits(p["wc"].T, p["bc"], hl))
    probs *= scale / total
    probs[k, column] -= scale
    g["wc"], g["bc"] = hl @ probs.T, probs.sum(axis=1)
    dl = p["wc"] @ probs
    for at, words in classes:
        q, total = _exponentials(_logits(p["wo"][words], p["bo"][words], hl[:, at]))
        q *= scale / total
        q[target[at] - words.start, column[: len(total)]] -= scale
        g["wo"][words], g["bo"][words] = q @ hl[:, at].T, q.sum(axis=1)
        dl[:, at] += p["wo"][words].T @ q
    dh = np.empty_like(dl)
    dh[:, order] = dl
    # What does not depend on later steps is taken over the whole window.
    z, r = run.gates[:STATE], run.gates[STATE:]
    keep = 1 - z
    to_new, to_z = keep * (1 - run.new * run.new), (run.before - run.new) * z * keep
    to_r = run.past * r * (1 - r)
    dx, dpast, back = np.empty((3 * STATE, len(k)), _F), np.empty_like(dl), p["wh"]
    carry = None
    for t in range(len(run.cuts) - 2, -1, -1):
        lo, hi = run.cuts[t], run.cuts[t + 1]
        d, du = dh[:, lo:hi], dx[:, lo:hi]
        if carry is not None:
            d[:, : carry.shape[1]] += carry
        dn = d * to_new[:, lo:hi]
        np.multiply(d, to_z[:, lo:hi], out=du[:STATE])
        np.multiply(dn, to_r[:, lo:hi], out=du[STATE : 2 * STATE])
        du[_NEW] = dn
        dp = np.multiply(dn, r[:, lo:hi], out=dpast[:, lo:hi])
        carry = back[:, _GATES] @ du[_GATES]
        carry += back[:, _NEW] @ dp
        carry += d * z[:, lo:hi]
        if run.ends[t] < run.ends[t + 1]:
            carry[:, run.fresh[run.ends[t] : run.ends[t + 1]] - lo] = 0
    g["wh"][:, _GATES], g["wh"][:, _NEW] = run.before @ dx[_GATES].T, run.before @ dpast.T
    # Inputs of one symbol share a row of `embed`: their sums come first, products after.
    x = grid.input[cells]
    order = np.argsort(x, kind="stable")
    first = np.flatnonzero(np.diff(x[order], prepend=-1))
    own, sums = x[order[first]], np.add.reduceat(np.take(dx, order, axis=1), first, axis=1).T
    g["b"] = sums.sum(axis=0)
    g["wx"] = p["embed"][own].T @ sums
    g["embed"][own] = sums @ p["wx"].T
    return g, run.state


def train(p: dict, symbols: np.ndarray, sizes: np.ndarray, width: int = 1024, rate: float = 0.03, clip: float = 1.0) -> dict:
    """One pass over the sequences in mixed order (very long ones first) by truncated backpropagation (`WINDOW` steps), with Adam.

    The rate falls with the symbols read, so the last, narrow windows, where only long sequences still run, move little.
    """
    p = {k: v.copy() for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    order = np.random.default_rng(len(sizes)).permutation(len(sizes))
    # Sequences longer than a lane's share start first, so they do not run on alone for longer than they must.
    order = order[np.argsort(sizes[order] * width <= len(symbols), kind="stable")]
    grid = Grid(symbols, sizes, width, order)
    h, step = np.zeros((STATE, int(grid.active[0])), _F), 0
    for a, b, cells in grid.windows():
        g, h = gradients(p, grid, a, b, cells, h)
        norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
        step += 1
        now = rate * (1 - cells.start / len(symbols))
        for k in p:
            d = g[k] * _F(min(1.0, clip / max(norm, 1e-12)))
            m[k] = _F(0.9) * m[k] + _F(0.1) * d
            v[k] = _F(0.99) * v[k] + _F(0.01) * d * d
            p[k] -= _F(now) * (m[k] / _F(1 - 0.9**step)) / (np.sqrt(v[k] / _F(1 - 0.99**step)) + _F(1e-6))
    return p
