"""Batched Pareto tails against a plain loop over samples and grid points, and the tail queries at their full size."""

from __future__ import annotations

import time

import numpy as np
import pytest

from factorloom.functions import tails
from factorloom.plans import catalogue, forecasting, inference, registry  # noqa: F401
from factorloom.sources import catalog as c

DATA = "/root/testdata/sf0.001"


def one_tail(losses, share=0.85, p=0.05, least=10):
    """Shortfall, value at risk, shape and exceedances of one sample; every grid point by itself."""
    u = np.quantile(losses, share)
    e = losses[losses > u] - u
    if len(e) < least:
        return np.nan, np.nan, np.nan, len(e)
    best = None
    for theta in [*(-(1 - np.logspace(-4, 0, 60)[:-1]) / e.max()), *(np.logspace(-4, 2, 80) / e.mean())]:
        k = np.mean(np.log1p(theta * e))
        if np.isfinite(k) and k / theta > 0:
            score = np.log(k / theta) + k + 1
            if best is None or (score, theta) < best[:2]:
                best = (score, theta, k)
    _, theta, shape = best
    scale = shape / theta
    if shape >= 0.95:
        return np.nan, np.nan, shape, len(e)
    var = u + scale / shape * ((p * len(losses) / len(e)) ** -shape - 1)
    return -(var + scale - shape * u) / (1 - shape) * 100, -var * 100, shape, len(e)


def samples():
    rng = np.random.default_rng(5)
    base = rng.standard_t(4, 60) * 0.03
    return np.concatenate([base[rng.integers(0, 60, (200, 60))], rng.uniform(-1, 1, (40, 60)), rng.exponential(1, (40, 60)), np.full((2, 60), 0.01)])


@pytest.mark.parametrize("least", [1, 4, 10])
def test_batch_equals_a_loop(least):
    x = samples()
    got = tails.pareto_tails(x, least=least, polish=0)
    for p in (0.05, 0.01):
        want = np.array([one_tail(r, p=p, least=least) for r in x])
        assert np.allclose(got.es[p], want[:, 0], rtol=1e-9, equal_nan=True) and np.allclose(got.var[p], want[:, 1], rtol=1e-9, equal_nan=True)
        assert np.allclose(got.shape, want[:, 2], rtol=1e-9, atol=1e-12, equal_nan=True) and (got.n == want[:, 3]).all()


def test_blocks_of_the_grid_change_nothing(monkeypatch):
    whole = tails.pareto_tails(samples())
    monkeypatch.setattr(tails, "GRID_NUMBERS", 5_000)
    assert np.array_equal(tails.pareto_tails(samples()).es[0.05], whole.es[0.05], equal_nan=True)


def test_polishing_reaches_the_likelihoods_top():
    x = np.random.default_rng(6).standard_t(4, (60, 2000)) * 0.01
    n = np.full(60, 300)
    e = -np.sort(-x, axis=1)[:, :300] - np.quantile(x, 0.85, axis=1)[:, None]
    value = lambda shape, scale: tails.profile((shape / scale)[:, None], e, n)[0][:, 0]
    rough, fine = tails.fit(e, n, 0), tails.fit(e, n, 8)
    assert (value(*fine) <= value(*rough)).all() and (value(*fine) < value(*rough) - 1e-9).any()
    theta = fine[0] / fine[1]
    around = np.stack([tails.profile((theta * (1 + d))[:, None], e, n)[0][:, 0] for d in (-1e-4, 1e-4)])
    assert (around >= value(*fine) - 1e-14).all()


def test_known_law():
    rng = np.random.default_rng(8)
    x = ((1 - rng.random((3, 200_000))) ** -0.2 - 1) / 0.2 * 0.01  # shape 0.2, scale 0.01
    t = tails.pareto_tails(x)
    assert np.allclose(t.shape, 0.2, atol=0.02) and np.allclose(t.var[0.01], -(0.01**-0.2 - 1) / 0.2, rtol=0.02)


def test_tails_of_daily_series(spark):
    got = inference.k17(spark, DATA).toPandas().set_index(["series", "u"])
    daily = c.series_day(spark, DATA).toPandas()
    assert len(got) == 12
    for (series, u), row in got.iterrows():
        losses = -daily[daily.series == series].r.to_numpy()
        want = tails.pareto_tails(losses[None], u)
        assert row.es5 == pytest.approx(want.es[0.05][0], nan_ok=True) and row.var1 == pytest.approx(want.var[0.01][0], nan_ok=True) and row.n == want.n[0]


@pytest.mark.parametrize("name", ["K18_pareto_bootstrap", "K18r_pareto_bootstrap_race"])
def test_the_whole_tail_bootstrap_ends(spark, name):
    inference.strats(spark, DATA, forecasting.whole_race if "race" in name else inference.baseline_race).count()  # forecasts are another query's work
    began = time.time()
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert time.time() - began < 60 and inference.TAIL_REPS == 2000
    assert got.groupby(["series", "model"])["level"].nunique().eq(2).all() and got.model.nunique() == (12 if "race" in name else 3) and got.n_boot.between(500, 2000).all()
