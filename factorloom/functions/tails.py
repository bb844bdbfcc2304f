"""Generalised Pareto tails of many samples at once: a row of a matrix is a sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Numbers that a block of the likelihood grid holds at once.
GRID_NUMBERS = 4_000_000
#: Shapes from here on have no usable mean.
LARGEST_SHAPE = 0.95


@dataclass
class Tails:
    """Of each sample: exceedances, shape, and by probability the expected shortfall and the value at risk in per cent of return."""

    n: np.ndarray
    shape: np.ndarray
    es: dict[float, np.ndarray]
    var: dict[float, np.ndarray]


def grid(e: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Ascending values of shape over scale that are tried for each row of exceedances."""
    top, mean = e[:, :1], (e.sum(axis=1) / k)[:, None]
    return np.concatenate([-(1 - np.logspace(-4, 0, 60)[:-1]) / top, np.logspace(-4, 2, 80) / mean], axis=1)


def profile(theta: np.ndarray, e: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative mean log-likelihood at each row's values of shape over scale, maximised over the other parameter, and the shape there."""
    shape = np.log1p(theta[:, :, None] * e[:, None, :]).sum(axis=2) / k[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(shape / theta > 0, np.log(shape / theta) + shape + 1, np.inf)
    flat = np.abs(theta) <= 1e-9
    return np.where(flat, np.log(e.sum(axis=1) / k)[:, None] + 1, score), np.where(flat, 0.0, shape)


def polished(theta: np.ndarray, low: np.ndarray, high: np.ndarray, e: np.ndarray, k: np.ndarray, steps: int) -> np.ndarray:
    """Newton's steps on the profile likelihood, kept between the neighbours on the grid; a step that gains nothing is not taken."""
    best, _ = profile(theta[:, None], e, k)
    for _ in range(steps):
        q = 1 / (1 + theta[:, None] * e)
        s = np.log1p(theta[:, None] * e).sum(axis=1) / k
        s1, s2 = (e * q).sum(axis=1) / k, -((e * q) ** 2).sum(axis=1) / k
        with np.errstate(divide="ignore", invalid="ignore"):
            slope, bend = s1 / s - 1 / theta + s1, s2 / s - (s1 / s) ** 2 + 1 / theta**2 + s2
            new = theta - slope / bend
        new = np.where((bend > 0) & (new > low) & (new < high), new, theta)
        score, _ = profile(new[:, None], e, k)
        gain = score[:, 0] < best[:, 0]
        theta, best = np.where(gain, new, theta), np.where(gain[:, None], score, best)
    return theta


def fit(e: np.ndarray, k: np.ndarray, polish: int) -> tuple[np.ndarray, np.ndarray]:
    """Shape and scale of each row of exceedances, falling and filled up with zeros, of which there are k."""
    tried = grid(e, k)
    score, shape = profile(tried, e, k)
    at, rows = score.argmin(axis=1), np.arange(len(e))
    theta = tried[rows, at]
    inner = (at > 0) & (at < tried.shape[1] - 1)
    if polish and inner.any():
        r, a = rows[inner], at[inner]
        theta[inner] = polished(theta[inner], tried[r, a - 1], tried[r, a + 1], e[inner], k[inner], polish)
    shape = profile(theta[:, None], e, k)[1][:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return shape, np.where(np.abs(theta) > 1e-9, shape / theta, e.sum(axis=1) / k)


def pareto_tails(losses: np.ndarray, share: float = 0.85, probabilities: tuple[float, ...] = (0.05, 0.01), least: int = 10, polish: int = 8) -> Tails:
    """Tails over each row's threshold, its `share` quantile.

    The likelihood is maximised over one number, shape over scale, on a grid and then by Newton's steps. Rows with fewer
    than `least` exceedances have no shape; those and rows with a shape near 1 have no shortfall and no value at risk.
    """
    rows, size = losses.shape
    u = np.quantile(losses, share, axis=1)
    n = (losses > u[:, None]).sum(axis=1)
    shape, scale = np.full(rows, np.nan), np.full(rows, np.nan)
    able = np.flatnonzero(n >= max(1, least))
    if len(able):
        most = int(n[able].max())
        e = np.maximum(-np.sort(-losses[able], axis=1)[:, :most] - u[able, None], 0)
        step = max(1, GRID_NUMBERS // (139 * most))
        for a in range(0, len(able), step):
            part = slice(a, a + step)
            shape[able[part]], scale[able[part]] = fit(e[part], n[able[part]], polish)
    zeta = n / size
    out = Tails(n, shape, {}, {})
    for p in probabilities:
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            straight = np.abs(shape) <= 1e-9
            var = u + np.where(straight, scale * np.log(zeta / p), scale / shape * ((p / zeta) ** -shape - 1))
            es = np.where(straight, var + scale, (var + scale - shape * u) / (1 - shape))
        usable = shape < LARGEST_SHAPE
        out.var[p], out.es[p] = np.where(usable, -var * 100, np.nan), np.where(usable, -es * 100, np.nan)
    return out
