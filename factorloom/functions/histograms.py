"""Gradient boosting over quantile bins: histograms of gradients and Hessians, leaf-wise growth.

A column is cut into bins once. A leaf's histogram holds, for every column and bin, the sums of gradients and Hessians and
the rows; its best cut is found in cumulative sums over the bins. Only the smaller child of a cut is counted anew, its sibling
is the parent less that child. The leaf with the greatest gain is cut next, until there are `leaves` of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from factorloom.functions.kernels import Predict, forward_splits

LEAVES, BINS = 31, 255


@dataclass
class Binner:
    """Interior edges of each column's bins: midpoints of distinct values, or quantiles where there are more of them than bins."""

    edges: list[np.ndarray]

    @classmethod
    def fitted(cls, x: np.ndarray, bins: int = BINS) -> Binner:
        edges = []
        for v in x.T:
            known = np.unique(v)
            mid = (known[1:] + known[:-1]) / 2
            edges.append(mid if len(known) <= bins else np.unique(np.quantile(v, np.arange(1, bins) / bins)))
        return cls(edges)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bin of each value: how many edges lie below it."""
        return np.stack([np.searchsorted(e, v, "left") for e, v in zip(self.edges, x.T, strict=True)], axis=1)


@dataclass
class Tree:
    """Nodes in order of creation: column and bin of the cut, children, value; a leaf has column -1."""

    column: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for part, v in ((self.column, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, value)):
            part.append(v)
        return len(self.value) - 1

    def predict(self, codes: np.ndarray) -> np.ndarray:
        column, cut, left, right = (np.array(a) for a in (self.column, self.cut, self.left, self.right))
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while (inner := column[at] >= 0).any():
            go = codes[rows[inner], column[at[inner]]] <= cut[at[inner]]
            at[inner] = np.where(go, left[at[inner]], right[at[inner]])
        return np.array(self.value)[at]


def histogram(codes: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Sums of gradients, Hessians and rows by column and bin: 3 x columns x width."""
    d = codes.shape[1]
    flat = (codes[rows] + np.arange(d) * width).ravel()
    return np.stack([np.bincount(flat, np.repeat(w, d), d * width) for w in (g[rows], h[rows], np.ones(len(rows)))]).reshape(3, d, width)


def best_cut(hist: np.ndarray, leaf: int) -> tuple[float, int, int]:
    """Gain, column and bin of the best cut of a leaf; the first of equal ones. A gain of 0 means there is none."""
    g, h, n = np.cumsum(hist, axis=2)
    g_all, h_all, n_all = g[:, -1:], h[:, -1:], n[:, -1:]
    able = (n >= leaf) & (n_all - n >= leaf) & (h > 1e-12) & (h_all - h > 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(able, g**2 / h + (g_all - g) ** 2 / (h_all - h) - g_all**2 / h_all, 0.0)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def grown(codes: np.ndarray, g: np.ndarray, h: np.ndarray, leaves: int, depth: int | None, leaf: int) -> Tree:
    """A tree whose leaves step by -sum of gradients over sum of Hessians."""
    width, tree = int(codes.max(initial=0)) + 1, Tree()
    queue: list[tuple[float, int, int, int, np.ndarray, np.ndarray, int]] = []

    def open_leaf(rows: np.ndarray, hist: np.ndarray, level: int) -> int:
        node = tree.add(-float(g[rows].sum() / max(h[rows].sum(), 1e-12)))
        if depth is None or level < depth:
            gain, column, cut = best_cut(hist, leaf)
            if gain > 1e-12:
                heapq.heappush(queue, (-gain, node, column, cut, rows, hist, level))
        return node

    every = np.arange(len(codes))
    open_leaf(every, histogram(codes, g, h, every, width), 0)
    count = 1
    while queue and count < leaves:
        _, node, column, cut, rows, hist, level = heapq.heappop(queue)
        go = codes[rows, column] <= cut
        low, high = rows[go], rows[~go]
        small = histogram(codes, g, h, low if len(low) <= len(high) else high, width)
        parts = (small, hist - small) if len(low) <= len(high) else (hist - small, small)
        tree.column[node], tree.cut[node] = column, cut
        tree.left[node], tree.right[node] = open_leaf(low, parts[0], level + 1), open_leaf(high, parts[1], level + 1)
        count += 1
    return tree


def boosted(x: np.ndarray, y: np.ndarray, slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: float, rounds: int, rate: float, depth: int | None, leaf: int, leaves: int = LEAVES, bins: int = BINS) -> Predict:
    """Rounds of trees on the gradients and Hessians at the current scores."""
    binner = Binner.fitted(x, bins)
    codes, trees = binner.codes(x), []
    score = np.full(len(y), start)
    for _ in range(rounds):
        tree = grown(codes, *slopes(score), leaves, depth, leaf)
        trees.append(tree)
        score = score + rate * tree.predict(codes)

    def predict(z: np.ndarray) -> np.ndarray:
        own = binner.codes(z)
        return start + rate * sum(t.predict(own) for t in trees)

    return predict


def squared(x: np.ndarray, y: np.ndarray, rate: float, depth: int | None, rounds: int = 100, leaf: int = 5, **more: int) -> Predict:
    return boosted(x, y, lambda s: (s - y, np.ones(len(y))), float(y.mean()), rounds, rate, depth, leaf, **more)


def regressor(rounds: int = 100, rates: tuple = (0.03, 0.1), depths: tuple = (3, None), leaf: int = 5) -> Callable[[np.ndarray, np.ndarray], Predict]:
    """Least squares; rate and depth by forward splits, the first of equal ones."""

    def fit(x: np.ndarray, y: np.ndarray) -> Predict:
        error = lambda a, d: sum(((y[te] - squared(x[tr], y[tr], a, d, rounds, leaf)(x[te])) ** 2).mean() for tr, te in forward_splits(len(y)))
        loss = {(a, d): error(a, d) for a in rates for d in depths}
        return squared(x, y, *min(loss, key=loss.get), rounds, leaf)

    return fit


def classifier(rounds: int = 100, rate: float = 0.05, depth: int | None = 3, leaf: int = 20) -> Callable[[np.ndarray, np.ndarray], Predict]:
    """Probability of class 1 by log loss."""

    def fit(x: np.ndarray, y: np.ndarray) -> Predict:
        squash = lambda s: 1 / (1 + np.exp(-s))

        def slopes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = squash(s)
            return p - y, p * (1 - p)

        odds = boosted(x, y, slopes, float(np.log(y.mean() / (1 - y.mean()))), rounds, rate, depth, leaf)
        return lambda z: squash(odds(z))

    return fit
