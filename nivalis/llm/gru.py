"""A gated recurrent language model in numpy, with a class-factored output softmax.

A word number w belongs to class w // width; P(w | state) = P(class | state) * P(w | class, state).
Documents are packed end to end into lanes.  Lanes advance together, the state is carried from
window to window and set to zero where a document begins.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

END, UNKNOWN = 0, 1


@dataclass
class Net:
    """The tables hold the input embeddings, already multiplied into the gates (update, reset) and
    the candidate, which are kept apart so that all arrays of a step are whole. The last row of the
    output weights is their bias: states carry a one behind their numbers."""

    table: np.ndarray  # words x 2 hidden
    table_new: np.ndarray  # words x hidden
    gates: np.ndarray  # hidden x 2 hidden
    gates_new: np.ndarray  # hidden x hidden
    to_class: np.ndarray  # hidden + 1 x classes
    to_word: np.ndarray  # classes x hidden + 1 x width

    @staticmethod
    def create(counts: np.ndarray, hidden: int, width: int, seed: int = 5) -> Net:
        """Random weights; the biases start at the words' frequencies."""
        rng = np.random.default_rng(seed)
        classes = -(-len(counts) // width)
        padded = np.zeros(classes * width)
        padded[: len(counts)] = counts
        mass = padded.reshape(classes, width)
        total = mass.sum(axis=1)
        with np.errstate(divide="ignore"):
            word_bias = np.where(mass > 0, np.log(mass) - np.log(total)[:, None], -1e4)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        to_class = np.zeros((hidden + 1, classes), np.float32)
        to_word = np.zeros((classes, hidden + 1, width), np.float32)
        to_class[-1], to_word[:, -1] = np.log(total / total.sum()), word_bias
        words = classes * width
        return Net(draw(words, 2 * hidden), draw(words, hidden), draw(hidden, 2 * hidden), draw(hidden, hidden), to_class, to_word)

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.table_new, self.gates, self.gates_new, self.to_class, self.to_word]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> Net:
        out, lo = [], 0
        for p in self.parts():
            out.append(flat[lo : lo + p.size].reshape(p.shape).astype(np.float32).copy())
            lo += p.size
        return Net(*out)


@dataclass(frozen=True)
class Lanes:
    """Time x lane arrays. Lanes are ordered by length, so those in use at a time come first."""

    inputs: np.ndarray
    targets: np.ndarray
    fresh: np.ndarray  # a document begins here
    doc: np.ndarray  # its number, -1 past the end of a lane
    used: np.ndarray  # lanes in use at each time


def pack(docs: list[np.ndarray], lanes: int) -> Lanes:
    """Longest documents first, each to the lane that is shortest so far. """
    lanes = max(1, min(lanes, len(docs)))
    heap, held = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        load, k = heapq.heappop(heap)
        held[k].append(d)
        heapq.heappush(heap, (load + len(docs[d]), k))
    held.sort(key=lambda own: -sum(len(docs[d]) for d in own))
    loads = np.array([sum(len(docs[d]) for d in own) for own in held])
    steps = int(loads[0])
    targets, doc = np.zeros((steps, lanes), np.int32), np.full((steps, lanes), -1, np.int32)
    inputs, fresh = np.full((steps, lanes), END, np.int32), np.zeros((steps, lanes), bool)
    for k, own in enumerate(held):
        at = 0
        for d in own:
            n = len(docs[d])
            targets[at : at + n, k], doc[at : at + n, k], fresh[at, k] = docs[d], d, True
            inputs[at + 1 : at + n, k] = docs[d][:-1]
            at += n
    return Lanes(inputs, targets, fresh, doc, (loads[None, :] > np.arange(steps)[:, None]).sum(axis=1))


def _step(net: Net, word: np.ndarray, h: np.ndarray, both: np.ndarray, candidate: np.ndarray) -> np.ndarray:
    """The state after a word; update and reset are left in `both` (lanes x 2 hidden)."""
    n = h.shape[1]
    np.matmul(h, net.gates, out=both)
    both += net.table[word]
    np.negative(both, out=both)
    np.exp(both, out=both)
    both += 1
    np.reciprocal(both, out=both)
    np.matmul(both[:, n:] * h, net.gates_new, out=candidate)
    candidate += net.table_new[word]
    candidate *= -2  # tanh by exponentials, which take half the time
    np.exp(candidate, out=candidate)
    candidate += 1
    np.divide(2, candidate, out=candidate)
    candidate -= 1
    after = candidate - h
    after *= both[:, :n]
    after += h
    return after


def _tame(weights: np.ndarray) -> bool:
    """Whether no state (its numbers lie within one) can drive a softmax out of range."""
    reach, bias = np.abs(weights[..., :-1, :]).sum(axis=-2), weights[..., -1, :]
    return bool((bias + reach).max() < 60 and (bias - reach).max(axis=-1).min() > -60)


def _softmax(x: np.ndarray, pick: np.ndarray, tame: bool) -> tuple[np.ndarray, np.ndarray]:
    """In place the exponentials of each row; their sums, and the log share of the picked entry."""
    if not tame:
        x -= x.max(axis=1, keepdims=True)
    chosen = x[np.arange(len(x)), pick]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    return total, chosen - np.log(total)


@dataclass(frozen=True)
class _Grouped:
    """Targets in order of their class, with the ranges of each class that occurs."""

    order: np.ndarray
    within: np.ndarray
    ranges: list[tuple[int, int, int]]

    @staticmethod
    def of(targets: np.ndarray, width: int) -> _Grouped:
        kind = (targets // width).astype(np.uint16)
        order = np.argsort(kind, kind="stable")
        kind = kind[order]
        edge = np.concatenate(([0], np.flatnonzero(np.diff(kind)) + 1, [len(kind)])).tolist() if len(kind) else [0]
        ranges = [(int(kind[a]), a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return _Grouped(order, targets[order] % width, ranges)

    def logits(self, net: Net, states: np.ndarray) -> np.ndarray:
        out = np.empty((len(states), net.to_word.shape[2]), np.float32)
        for c, a, b in self.ranges:
            np.matmul(states[a:b], net.to_word[c], out=out[a:b])
        return out


def log_probabilities(net: Net, states: np.ndarray, targets: np.ndarray, tame: tuple[bool, bool] = (False, False)) -> np.ndarray:
    """Natural log of P(target | state), row by row; states end in a one."""
    width = net.to_word.shape[2]
    out = _softmax(states @ net.to_class, targets // width, tame[0])[1].astype(float)
    by = _Grouped.of(targets, width)
    out[by.order] += _softmax(by.logits(net, states[by.order]), by.within, tame[1])[1]
    return out


def score(net: Net, docs: list[np.ndarray], lanes: int = 512, window: int = 64) -> np.ndarray:
    """Log-likelihood of each whole document, window by window."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    packed, hidden = pack(docs, lanes), net.gates.shape[0]
    tame = _tame(net.to_class), _tame(net.to_word)
    h = np.zeros((packed.inputs.shape[1], hidden), np.float32)
    both, candidate = np.empty((len(h), 2 * hidden), np.float32), np.empty((len(h), hidden), np.float32)
    for lo in range(0, len(packed.inputs), window):
        hi = min(lo + window, len(packed.inputs))
        h = h[: packed.used[lo]]
        states = np.ones((hi - lo, len(h), hidden + 1), np.float32)
        for t in range(lo, hi):
            a = packed.used[t]
            h = _step(net, packed.inputs[t, :a], h[:a] * ~packed.fresh[t, :a, None], both[:a], candidate[:a])
            states[t - lo, :a, :hidden] = h
        doc = packed.doc[lo:hi, : states.shape[1]]
        real = doc >= 0
        logs = log_probabilities(net, states[real], packed.targets[lo:hi, : states.shape[1]][real], tame)
        total += np.bincount(doc[real], weights=logs, minlength=len(docs))
    return total


def gradients(net: Net, inputs, targets, fresh, real, h):
    """Of the mean negative log-likelihood of a window, truncated at its begin: (loss sum, tokens,
    gradients in the order of Net.parts, last state)."""
    steps, lanes = inputs.shape
    n, width = h.shape[1], net.to_word.shape[2]
    keep = (~fresh).astype(np.float32)[:, :, None]
    before, candidate = np.empty((steps, lanes, n), np.float32), np.empty((steps, lanes, n), np.float32)
    gates = np.empty((steps, lanes, 2 * n), np.float32)
    states = np.ones((steps, lanes, n + 1), np.float32)
    for t in range(steps):
        np.multiply(h, keep[t], out=before[t])
        h = _step(net, inputs[t], before[t], gates[t], candidate[t])
        states[t, :, :n] = h
    # the output layers
    use = np.flatnonzero(real.ravel())
    by = _Grouped.of(targets.ravel()[use], width)
    use = use[by.order]
    s, kind, rows = states.reshape(-1, n + 1)[use], np.repeat([c for c, _, _ in by.ranges], [b - a for _, a, b in by.ranges]), np.arange(len(use))
    d = s @ net.to_class
    total, logs = _softmax(d, kind, _tame(net.to_class))
    loss = -logs.sum(dtype=float)
    d *= (1 / (total * len(use)))[:, None]
    d[rows, kind] -= np.float32(1 / len(use))
    g_class, d_s = s.T @ d, d @ net.to_class[:n].T
    d = by.logits(net, s)
    total, logs = _softmax(d, by.within, _tame(net.to_word))
    loss -= logs.sum(dtype=float)
    d *= (1 / (total * len(use)))[:, None]
    d[rows, by.within] -= np.float32(1 / len(use))
    g_word = np.zeros_like(net.to_word)
    for c, a, b in by.ranges:
        np.matmul(s[a:b].T, d[a:b], out=g_word[c])
        d_s[a:b] += d[a:b] @ net.to_word[c, :n].T
    d_states = np.zeros((steps * lanes, n), np.float32)
    d_states[use] = d_s
    d_states = d_states.reshape(steps, lanes, n)
    # back through time; the factors of all steps at once
    z, r = np.ascontiguousarray(gates[..., :n]), np.ascontiguousarray(gates[..., n:])
    to_z, to_c, to_r = (candidate - before) * z * (1 - z), z * (1 - candidate * candidate), before * r * (1 - r)
    stay, both, last = (1 - z) * keep, net.gates.T.copy(), net.gates_new.T.copy()
    d_x, d_c, d_h = np.empty((steps, lanes, 2 * n), np.float32), np.empty((steps, lanes, n), np.float32), np.zeros((lanes, n), np.float32)
    for t in range(steps - 1, -1, -1):
        d_h += d_states[t]
        np.multiply(d_h, to_z[t], out=d_x[t, :, :n])
        np.multiply(d_h, to_c[t], out=d_c[t])
        d_rh = d_c[t] @ last
        np.multiply(d_rh, to_r[t], out=d_x[t, :, n:])
        d_rh *= r[t]
        d_rh += d_x[t] @ both
        d_rh *= keep[t]
        d_h *= stay[t]
        d_h += d_rh
    flat_x, flat_c, flat_before = d_x.reshape(-1, 2 * n), d_c.reshape(-1, n), before.reshape(-1, n)
    g_gates, g_new = flat_before.T @ flat_x, (r.reshape(-1, n) * flat_before).T @ flat_c
    words = inputs.ravel()
    order = np.argsort(words.astype(np.uint16) if len(net.table) <= 1 << 16 else words, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(words[order]) > 0)))
    g_table, g_table_new = np.zeros_like(net.table), np.zeros_like(net.table_new)
    for g, d in ((g_table, flat_x), (g_table_new, flat_c)):
        g[words[order][first]] = np.add.reduceat(d[order], first, axis=0)
    return loss, len(use), [g_table, g_table_new, g_gates, g_new, g_class, g_word], h


class Adam:
    def __init__(self, net: Net, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.mean = [np.zeros_like(p) for p in net.parts()]
        self.square = [np.zeros_like(p) for p in net.parts()]

    def update(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads))
        shrink = np.float32(min(1.0, 5.0 / max(norm, 1e-12)))
        rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for p, g, m, v in zip(self.net.parts(), grads, self.mean, self.square, strict=True):
            g *= shrink
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            g *= np.float32(0.001)
            v *= np.float32(0.999)
            v += g
            np.sqrt(v, out=g)
            g += np.float32(1e-8)
            np.divide(m, g, out=g)
            g *= rate
            p -= g


def train(net: Net, optimiser: Adam, docs: list[np.ndarray], window: int, lanes: int, updates: int, longest: int = 4096) -> tuple[float, int]:
    """One pass of truncated back-propagation over whole documents; (loss sum, tokens). Documents of
    more than `longest` tokens are taught in pieces, each from a zero state. Lanes are narrowed where
    the documents would otherwise give fewer than `updates` steps."""
    docs = [d[k : k + longest] for d in docs for k in range(0, len(d), longest)]
    if not docs:
        return 0.0, 0
    size = sum(map(len, docs))
    packed = pack(docs, int(np.clip(size // (window * updates), 8, lanes)))
    h = np.zeros((packed.inputs.shape[1], net.gates.shape[0]), np.float32)
    loss, tokens = 0.0, 0
    for lo in range(0, len(packed.inputs), window):
        own, a = slice(lo, lo + window), packed.used[lo]
        real = packed.doc[own, :a] >= 0
        part, n, grads, h = gradients(net, packed.inputs[own, :a], packed.targets[own, :a], packed.fresh[own, :a], real, h[:a])
        optimiser.update(grads)
        loss, tokens = loss + part, tokens + n
    return loss, tokens
