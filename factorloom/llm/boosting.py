"""Gradient-boosted regression trees on binned features for a yes-or-no target, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Tree:
    """Complete binary tree in level order; a leaf's feature is -1."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def apply(self, x: np.ndarray, depth: int) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(depth):
            f = self.feature[at]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.threshold[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return self.value[at]


@dataclass(frozen=True)
class Boosted:
    """Sum of trees' log-odds."""

    base: float
    trees: list[Tree]
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.apply(x, self.depth)
        return out


def _grow(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float, least: float) -> Tree:
    nodes = 2 ** (depth + 1) - 1
    feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    rows = {0: np.arange(len(g))}
    k = codes.shape[1]
    for node in range(nodes):
        own = rows.pop(node, None)
        if own is None:
            continue
        sg, sh = g[own].sum(), h[own].sum()
        value[node] = -rate * sg / (sh + ridge)
        if node >= 2**depth - 1 or len(own) < 2 * least:
            continue
        flat = (codes[own] + np.arange(k) * BINS).ravel()
        hg = np.bincount(flat, np.repeat(g[own], k), minlength=k * BINS).reshape(k, BINS).cumsum(axis=1)
        hh = np.bincount(flat, np.repeat(h[own], k), minlength=k * BINS).reshape(k, BINS).cumsum(axis=1)
        gain = hg**2 / (hh + ridge) + (sg - hg) ** 2 / (sh - hh + ridge) - sg**2 / (sh + ridge)
        gain[(hh < 1e-6) | (sh - hh < 1e-6)] = -1
        best = int(gain.argmax())
        f, b = divmod(best, BINS)
        if gain[f, b] <= 1e-6 or b >= len(edges[f]):
            continue
        feature[node], threshold[node] = f, edges[f][b]
        right = codes[own, f] > b
        rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return Tree(feature, threshold, value)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, ridge: float = 1.0, least: int = 5) -> Boosted:
    """Fit to rows x and targets y (0 or 1) on the logistic loss."""
    edges = []
    codes = np.empty(x.shape, np.int64)
    for f in range(x.shape[1]):
        e = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        e = e[e < x[:, f].max()]
        edges.append(e)
        codes[:, f] = np.searchsorted(e, x[:, f], side="left")
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    raw, grown = np.full(len(y), base), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        t = _grow(codes, edges, q - y, np.maximum(1e-6, q * (1 - q)), depth, rate, ridge, least)
        grown.append(t)
        raw += t.apply(x, depth)
    return Boosted(base, grown, depth)
