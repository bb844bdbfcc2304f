"""Boosting over histograms against exact cuts tried one by one."""

from __future__ import annotations

import numpy as np
import pytest

from factorloom.functions import histograms


def data(n=300, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    return x, 2 * (x[:, 0] > 0.3) - 1.5 * (x[:, 1] < -0.5) * x[:, 2] + 0.1 * rng.normal(size=n)


def exact_cut(codes, g, h, rows, leaf):
    """Best gain over every column and bin, each from its rows."""
    best = (1e-12, None, None)
    whole = g[rows].sum() ** 2 / h[rows].sum()
    for j in range(codes.shape[1]):
        for cut in range(codes[:, j].max()):
            low, high = rows[codes[rows, j] <= cut], rows[codes[rows, j] > cut]
            if min(len(low), len(high)) >= leaf:
                gain = g[low].sum() ** 2 / h[low].sum() + g[high].sum() ** 2 / h[high].sum() - whole
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, j, cut)
    return best


def exact_tree(codes, g, h, leaves, depth, leaf):
    """Values of all rows under leaf-wise growth by exact cuts."""
    parts = [(np.arange(len(codes)), 0)]
    while len(parts) < leaves:
        able = [(*exact_cut(codes, g, h, rows, leaf), k) for k, (rows, level) in enumerate(parts) if depth is None or level < depth]
        able = [a for a in able if a[1] is not None]
        if not able:
            break
        _, j, cut, k = max(able, key=lambda a: a[0])
        rows, level = parts.pop(k)
        parts += [(rows[codes[rows, j] <= cut], level + 1), (rows[codes[rows, j] > cut], level + 1)]
    out = np.zeros(len(codes))
    for rows, _ in parts:
        out[rows] = -g[rows].sum() / h[rows].sum()
    return out


@pytest.mark.parametrize(("leaves", "depth", "leaf"), [(2, None, 1), (8, None, 5), (31, 3, 5), (12, 4, 20)])
def test_trees_equal_exact_cuts_on_binned_data(leaves, depth, leaf):
    rng = np.random.default_rng(1)
    x, y = data()
    codes = histograms.Binner.fitted(x, 16).codes(x)
    for h in (np.ones(len(y)), rng.uniform(0.1, 1, len(y))):
        tree = histograms.grown(codes, -y, h, leaves, depth, leaf)
        assert np.allclose(tree.predict(codes), exact_tree(codes, -y, h, leaves, depth, leaf))
        assert sum(c < 0 for c in tree.column) <= leaves


def test_siblings_are_the_parent_less_the_child():
    x, y = data()
    codes = histograms.Binner.fitted(x).codes(x)
    rows, h = np.arange(len(y)), np.ones(len(y))
    low = rows[codes[:, 0] <= 40]
    width = codes.max() + 1
    whole, part, rest = (histograms.histogram(codes, y, h, r, width) for r in (rows, low, np.setdiff1d(rows, low)))
    assert np.allclose(whole - part, rest)


def test_bins_keep_the_order_and_share_the_rows():
    x = np.random.default_rng(2).exponential(size=(10_000, 1))
    b = histograms.Binner.fitted(x)
    codes = b.codes(x)[:, 0]
    assert codes.max() == 254 and np.bincount(codes).max() < 60 and (np.diff(codes[np.argsort(x[:, 0])]) >= 0).all()
    few = np.array([[1.0], [1.0], [2.0], [5.0]])
    assert histograms.Binner.fitted(few).codes(few)[:, 0].tolist() == [0, 0, 1, 2]


def test_it_learns_and_leaves_constants_alone():
    x, y = data(600)
    p = histograms.regressor()(x[:400], y[:400])
    assert np.mean((p(x[400:]) - y[400:]) ** 2) < 0.25 * y[400:].var()
    q = histograms.classifier()(x[:400], (y[:400] > 0.5).astype(float))(x[400:])
    assert ((q > 0.5) == (y[400:] > 0.5)).mean() > 0.9 and (q >= 0).all() and (q <= 1).all()
    assert np.allclose(histograms.squared(np.zeros((30, 2)), np.arange(30.0), 0.1, None)(np.ones((3, 2))), 14.5)
