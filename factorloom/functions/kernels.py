"""Estimators in NumPy for one training window: fit(x, y) gives a function from rows to predictions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Predict = Callable[[np.ndarray], np.ndarray]


def standardised(fit: Callable[[np.ndarray, np.ndarray], Predict]) -> Callable[[np.ndarray, np.ndarray], Predict]:
    """Scale columns by the training rows' mean and population deviation."""

    def run(x: np.ndarray, y: np.ndarray) -> Predict:
        m, s = x.mean(axis=0), x.std(axis=0)
        s = np.where(s > 0, s, 1.0)
        p = fit((x - m) / s, y)
        return lambda z: p((z - m) / s)

    return run


def ols(x: np.ndarray, y: np.ndarray) -> Predict:
    b = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    return lambda z: b[0] + z @ b[1:]


def ridge_loo(x: np.ndarray, y: np.ndarray, grid: np.ndarray | None = None) -> Predict:
    """Ridge with an unpenalised intercept; the penalty by leave-one-out error in closed form."""
    grid = np.logspace(-3, 3, 13) if grid is None else grid
    mx, my = x.mean(axis=0), y.mean()
    u, s, vt = np.linalg.svd(x - mx, full_matrices=False)
    uy = u.T @ (y - my)
    best = None
    for a in grid:
        shrink = s**2 / (s**2 + a)
        residual = (y - my) - u @ (shrink * uy)
        lever = (u**2) @ shrink + 1 / len(y)
        loss = np.mean((residual / np.maximum(1e-9, 1 - lever)) ** 2)
        if best is None or loss < best[0]:
            best = (loss, vt.T @ (np.where(s > 1e-12, s / (s**2 + a), 0) * uy))
    b = best[1]
    return lambda z: my + (z - mx) @ b


def forward_splits(n: int, k: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """k forward splits: each test part follows all of its training rows."""
    size = n // (k + 1)
    starts = range(n - k * size, n, size)
    return [(np.arange(s), np.arange(s, s + size)) for s in starts]


def _descend(x: np.ndarray, y: np.ndarray, penalty: float, b: np.ndarray, rounds: int = 500, tol: float = 1e-7) -> np.ndarray:
    n, norm = len(y), (x**2).sum(axis=0)
    r = y - x @ b
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(norm > 0):
            old = b[j]
            rho = x[:, j] @ r + norm[j] * old
            b[j] = np.sign(rho) * max(0.0, abs(rho) - penalty * n) / norm[j]
            if b[j] != old:
                r -= x[:, j] * (b[j] - old)
                moved = max(moved, abs(b[j] - old))
        if moved < tol:
            break
    return b


def lasso_cv(x: np.ndarray, y: np.ndarray, n_grid: int = 20) -> Predict:
    """Lasso by coordinate descent; the penalty by forward splits."""
    mx, my = x.mean(axis=0), y.mean()
    top = np.abs((x - mx).T @ (y - my)).max() / len(y)
    grid = top * np.logspace(0, -3, n_grid)
    loss = np.zeros(n_grid)
    for tr, te in forward_splits(len(y)):
        m, c = x[tr].mean(axis=0), y[tr].mean()
        b = np.zeros(x.shape[1])
        for i, a in enumerate(grid):
            b = _descend(x[tr] - m, y[tr] - c, a, b)
            loss[i] += ((y[te] - c - (x[te] - m) @ b) ** 2).mean()
    b = _descend(x - mx, y - my, grid[int(loss.argmin())], np.zeros(x.shape[1]))
    return lambda z: my + (z - mx) @ b


#: Entries (nodes x columns x rows) that one step of a forest's growth holds.
STEP_ENTRIES = 1_000_000


class Forest:
    """Regression trees by least squares, one for each row of `samples`, grown level by level; all cuts between sorted values are tried.

    Nodes of a level that hold equally many rows are cut together. Every node keeps its mean, so a tree of less depth is the
    same tree read down to that depth.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, samples: np.ndarray, depth: int, leaf: int):
        rank = np.stack([np.unique(v, return_inverse=True)[1].ravel() for v in x.T]).astype(np.min_scalar_type(len(x)))
        self.roots, size = np.arange(len(samples)), len(samples)
        parts = []
        level, nodes = 0, {samples.shape[1]: [(self.roots, samples)]}
        while nodes:
            later: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for m, each in nodes.items():
                ids, rows = (np.concatenate(a) for a in zip(*each, strict=True))
                step = max(1, STEP_ENTRIES // (m * x.shape[1]))
                for at in range(0, len(ids), step):
                    own, held = ids[at : at + step], rows[at : at + step]
                    value = y[held].mean(axis=1)
                    column, cut, left = np.full(len(own), -1), np.zeros(len(own)), np.zeros(len(own), np.int64)
                    if level < depth and m >= 2 * leaf:
                        column, cut = self.cuts(x, y, rank, held, value, leaf)
                        inner = np.flatnonzero(column >= 0)
                        left[inner] = size + 2 * np.arange(len(inner))
                        size += 2 * len(inner)
                        go = x[held[inner], column[inner, None]] <= cut[inner, None]
                        low = go.sum(axis=1)
                        for n in np.unique(low):
                            chosen = inner[low == n]
                            side, mine = go[low == n], held[chosen]
                            later.setdefault(int(n), []).append((left[chosen], mine[side].reshape(-1, n)))
                            later.setdefault(m - int(n), []).append((left[chosen] + 1, mine[~side].reshape(-1, m - n)))
                    parts.append((own, value, column, cut, left, np.full(len(own), level)))
            level, nodes = level + 1, later
        ids, *columns = (np.concatenate(a) for a in zip(*parts, strict=True))
        order = np.argsort(ids)
        self.value, self.column, self.cut, self.left, self.level = (a[order] for a in columns)

    @staticmethod
    def cuts(x: np.ndarray, y: np.ndarray, rank: np.ndarray, rows: np.ndarray, value: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Column (-1: none) and threshold of the best cut of each node, the first of equal ones; `rows` is nodes x rows."""
        m, d = rows.shape[1], np.arange(x.shape[1])[:, None]
        order = np.argsort(rank[d[:, :, None], rows], axis=-1, kind="stable")
        sorted_rows = rows[np.arange(len(rows))[None, :, None], order]
        v, t = rank[d[:, :, None], sorted_rows], y[sorted_rows] - value[:, None]
        left = np.cumsum(t, axis=-1)[..., :-1]
        n = np.arange(1, m)
        gain = left**2 / n + left**2 / (m - n)
        gain[(v[..., 1:] == v[..., :-1]) | (n < leaf) | (m - n < leaf)] = -1
        place = gain.argmax(axis=-1)
        best = np.take_along_axis(gain, place[..., None], -1)[..., 0]
        column, node = best.argmax(axis=0), np.arange(len(rows))
        k = place[column, node]
        cut = (x[sorted_rows[column, node, k], column] + x[sorted_rows[column, node, k + 1], column]) / 2
        return np.where(best[column, node] > 1e-12, column, -1), cut

    def predict(self, z: np.ndarray, depth: int) -> np.ndarray:
        """Mean of the trees read down to a depth."""
        at = np.repeat(self.roots[:, None], len(z), axis=1)
        while (inner := (self.column[at] >= 0) & (self.level[at] < depth)).any():
            go = z[np.arange(len(z)), self.column[at]] <= self.cut[at]
            at = np.where(inner, self.left[at] + ~go, at)
        return np.mean(self.value[at], axis=0)


def forest(trees: int = 300, depths: tuple = (3, 5, 30), leaves: tuple = (5, 10), seed: int = 42) -> Callable[[np.ndarray, np.ndarray], Predict]:
    """Bagged trees; depth and leaf size by forward splits with as many trees."""

    def bag(x: np.ndarray, y: np.ndarray, depth: int, leaf: int) -> Forest:
        rng = np.random.default_rng(seed)
        return Forest(x, y, np.stack([rng.integers(0, len(y), len(y)) for _ in range(trees)]), depth, leaf)

    def fit(x: np.ndarray, y: np.ndarray) -> Predict:
        loss = {(d, m): 0.0 for d in depths for m in leaves}
        for tr, te in forward_splits(len(y)):
            for m in leaves:
                own = bag(x[tr], y[tr], max(depths), m)
                for d in depths:
                    loss[d, m] += ((y[te] - own.predict(x[te], d)) ** 2).mean()
        depth, leaf = min(loss, key=loss.get)
        own = bag(x, y, depth, leaf)
        return lambda z: own.predict(z, depth)

    return fit


class Adam:
    """Adam steps over a list of arrays, in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.p, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def mlp(hidden: tuple = (32, 16), decay: float = 1e-2, steps: int = 400, rate: float = 5e-3, seed: int = 42) -> Callable[[np.ndarray, np.ndarray], Predict]:
    """Small network of rectified layers, squared error with decay."""

    def fit(x: np.ndarray, y: np.ndarray) -> Predict:
        rng = np.random.default_rng(seed)
        sizes = [x.shape[1], *hidden, 1]
        w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        c = [np.zeros(b) for b in sizes[1:]]
        c[-1][:] = y.mean()
        adam = Adam(w + c, rate)

        def forward(z: np.ndarray) -> list[np.ndarray]:
            out = [z]
            for k, (a, b) in enumerate(zip(w, c, strict=True)):
                h = out[-1] @ a + b
                out.append(h if k == len(w) - 1 else np.maximum(h, 0))
            return out

        for _ in range(steps):
            layers = forward(x)
            g = 2 * (layers[-1] - y[:, None]) / len(y)
            gw, gc = [], []
            for k in range(len(w) - 1, -1, -1):
                gw.append(layers[k].T @ g + decay * w[k] / len(y))
                gc.append(g.sum(axis=0))
                g = (g @ w[k].T) * (layers[k] > 0)
            adam.step(gw[::-1] + gc[::-1])
        return lambda z: forward(z)[-1][:, 0]

    return fit


def lstm(hidden: int = 24, steps: int = 150, rate: float = 5e-3, seed: int = 42) -> Callable[[np.ndarray, np.ndarray], Predict]:
    """One recurrent layer with gates over sequences (n, length, columns), read at the last step."""

    def fit(x: np.ndarray, y: np.ndarray) -> Predict:
        rng = np.random.default_rng(seed)
        d, h = x.shape[2], hidden
        wx, wh, b = rng.normal(0, 0.2, (d, 4 * h)), rng.normal(0, 0.2, (h, 4 * h)), np.zeros(4 * h)
        wo, bo = rng.normal(0, 0.2, (h, 1)), np.array([y.mean()])
        adam = Adam([wx, wh, b, wo, bo], rate)
        squash = lambda v: 1 / (1 + np.exp(-v))

        def forward(z: np.ndarray):
            hs, cs, gates = [np.zeros((len(z), h))], [np.zeros((len(z), h))], []
            for t in range(z.shape[1]):
                a = z[:, t] @ wx + hs[-1] @ wh + b
                i, f, o, g = squash(a[:, :h]), squash(a[:, h : 2 * h]), squash(a[:, 2 * h : 3 * h]), np.tanh(a[:, 3 * h :])
                cs.append(f * cs[-1] + i * g)
                hs.append(o * np.tanh(cs[-1]))
                gates.append((i, f, o, g))
            return hs, cs, gates, hs[-1] @ wo + bo

        for _ in range(steps):
            hs, cs, gates, out = forward(x)
            g_out = 2 * (out - y[:, None]) / len(y)
            gwo, gbo = hs[-1].T @ g_out, g_out.sum(axis=0)
            gh, gc = g_out @ wo.T, np.zeros((len(x), h))
            gwx, gwh, gb = np.zeros_like(wx), np.zeros_like(wh), np.zeros_like(b)
            for t in range(x.shape[1] - 1, -1, -1):
                i, f, o, g = gates[t]
                tc = np.tanh(cs[t + 1])
                gc = gc + gh * o * (1 - tc**2)
                a = np.concatenate([gc * g * i * (1 - i), gc * cs[t] * f * (1 - f), gh * tc * o * (1 - o), gc * i * (1 - g**2)], axis=1)
                gwx += x[:, t].T @ a
                gwh += hs[t].T @ a
                gb += a.sum(axis=0)
                gh, gc = a @ wh.T, gc * f
            adam.step([gwx, gwh, gb, gwo, gbo])
        return lambda z: forward(z)[3][:, 0]

    return fit


def logistic(x: np.ndarray, y: np.ndarray, c: float = 0.5, steps: int = 50) -> Predict:
    """Logistic regression with inverse penalty c, by Newton's method; predictions are probabilities."""
    z = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-9] + [1 / c] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return lambda q: 1 / (1 + np.exp(-np.clip(w[0] + q @ w[1:], -35, 35)))
