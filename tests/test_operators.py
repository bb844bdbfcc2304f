"""Operators and kernels on small hand-made frames."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.functions import histograms, kernels
from factorloom.functions.tails import pareto_tails
from factorloom.operators import bootstrap, calendar, forecast, legs, metrics, reshape, rolling, sorts
from factorloom.sources import files


def days(n, start=date(2020, 1, 1)):
    return [start + timedelta(i) for i in range(n)]


def test_returns_are_null_across_a_gap(spark):
    d = days(4)
    px = spark.createDataFrame([(d[0], "A", 10.0), (d[1], "A", 11.0), (d[3], "A", 22.0), (d[2], "B", 1.0)], "date date, code string, adj_close double")
    got = {(r.code, r.date): r.ret for r in legs.calendar_returns(px, calendar.ordinals(px, "date", "di")).collect()}
    assert got[("A", d[1])] == pytest.approx(0.1)
    assert got[("A", d[3])] is None and got[("A", d[0])] is None


def test_tied_quantile_edges_are_dropped(spark):
    x = [1, 1, 1, 1, 2, 3, 4, 5, 6, 7]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "g int, i int, v double")
    got = [r.bucket for r in sorts.quantile_buckets(df, "v", 5, ["g"]).orderBy("i").collect()]
    assert got == [0, 0, 0, 0, 1, 1, 2, 2, 3, 3]


def test_missing_return_renormalises_or_freezes(spark):
    d = days(2)
    rows = [(1, "win", "A", d[0], 1, 1.0, 0.1), (1, "win", "B", d[0], 1, 1.0, None), (1, "win", "A", d[1], 2, 1.0, 0.0), (1, "win", "B", d[1], 2, 1.0, 0.2)]
    held = spark.createDataFrame(rows, "k int, leg string, code string, date date, di long, w0 double, ret double")
    a = {r.date: r.ret for r in legs.leg_returns(held).collect()}
    b = {r.date: r.ret for r in legs.leg_returns(held, missing="freeze").collect()}
    assert a[d[0]] == pytest.approx(0.1) and b[d[0]] == pytest.approx(0.05)
    assert a[d[1]] == pytest.approx((1.1 * 0 + 1.0 * 0.2) / 2.1) and b[d[1]] == pytest.approx(2.3 / 2.1 - 1)


@pytest.mark.parametrize(("n", "worst"), [(1, 1), (39, 1), (40, 2), (41, 2)])
def test_shortfall_counts(spark, n, worst):
    df = spark.createDataFrame([("s", float(i)) for i in range(n)], "series string, r double")
    assert metrics.expected_shortfall(df, "r", ["series"]).first().es == pytest.approx(100 * np.mean(range(worst)))


def test_constant_series_has_no_ratio(spark):
    df = spark.createDataFrame([(0.1,)] * 5, "r double")
    assert df.agg(metrics.sharpe("r").alias("s")).first().s is None


def test_full_loss_has_no_certainty_equivalent(spark):
    df = spark.createDataFrame([(0.1,), (-1.0,)], "r double")
    assert df.agg(metrics.crra_certainty("r", 5).alias("c")).first().c is None


def test_window_waits_until_full(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([1.0, None, 2.0, 3.0, 4.0])], "series string, t int, r double")
    w = rolling.trailing(["series"], "t", 3)
    from pyspark.sql import functions as F

    got = [r.v for r in df.select("t", rolling.full(F.sum("r"), "r", w, 3).alias("v")).orderBy("t").collect()]
    assert got == [None, None, None, None, 9.0]


def test_as_of_takes_the_latest(spark):
    a = spark.createDataFrame([(d,) for d in days(4)], "at date")
    b = spark.createDataFrame([(days(4)[1],), (days(4)[2],)], "seen date")
    got = [r.seen for r in reshape.as_of(a, b, "at", "seen").orderBy("at").collect()]
    assert got == [None, days(4)[1], days(4)[2], days(4)[2]]


def test_sectioned_file(spark):
    df = spark.createDataFrame([(days(3)[0], 0.01, 0.02), (days(3)[1], None, -0.03)], "date date, a double, b double")
    got = {(r.date, r.name): r.value for r in files.sectioned(files.write_sectioned(df, "Mine -- Daily"), "Mine -- Daily", ["a", "b"]).collect()}
    assert got[(days(3)[0], "a")] == pytest.approx(0.01) and got[(days(3)[1], "a")] is None and len(got) == 4


def test_bootstrap_rows_are_blocks(spark):
    sizes = spark.createDataFrame([("s", 30)], "series string, n long")
    got = bootstrap.block_index(sizes, 3).orderBy("b", "pos").collect()
    assert len(got) == 90
    for a, b in zip(got, got[1:]):
        assert b.pos % 12 == 0 or a.b != b.b or b.i == (a.i + 1) % 30


def test_step_down_is_monotone(spark):
    rng = np.random.default_rng(0)
    boot = spark.createDataFrame([("s", b, m, float(rng.normal(k, 1))) for b in range(200) for k, m in enumerate("abc")], "series string, b int, model string, d double")
    seen = spark.createDataFrame([("s", m, float(k)) for k, m in enumerate("abc")], "series string, model string, obs double")
    got = bootstrap.step_down(boot, seen, ["series"]).orderBy("t", ascending=False).collect()
    p = [r.rw_p for r in got]
    assert p == sorted(p) and all(0 <= x <= 1 for x in p)


def test_folds_hold_only_the_past_and_the_test_rows(spark):
    x = spark.createDataFrame([("s", t) for t in range(50)], "series string, t long")
    got = forecast.fold_rows(x).collect()
    by = {}
    for r in got:
        by.setdefault(r.t0, set()).add(r.t)
    assert set(by) == {36, 42, 48} and all(set(range(t0)) <= v and max(v) < t0 + 6 for t0, v in by.items())


def test_ridge_leave_one_out_matches_refits():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(25, 4)), rng.normal(size=25)
    grid = np.array([0.1, 1.0, 30.0])

    def one(a, i):
        k = np.arange(25) != i
        return (kernels.ridge_loo(x[k], y[k], np.array([a]))(x[i : i + 1])[0] - y[i]) ** 2

    best = min(grid, key=lambda a: np.mean([one(a, i) for i in range(25)]))
    z = rng.normal(size=(5, 4))
    assert np.allclose(kernels.ridge_loo(x, y, grid)(z), kernels.ridge_loo(x, y, np.array([best]))(z))


def test_ols_and_lasso_recover_a_line():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = 1 + 2 * x[:, 0] + rng.normal(0, 0.01, 200)
    z = np.eye(3)
    assert np.allclose(kernels.ols(x, y)(z), [3, 1, 1], atol=0.02)
    assert np.allclose(kernels.lasso_cv(x, y)(z), [3, 1, 1], atol=0.1)


@pytest.mark.parametrize("fit", [kernels.forest(20), histograms.regressor(40), kernels.standardised(kernels.mlp(steps=300))])
def test_learners_beat_the_mean(fit):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 3))
    y = np.sin(2 * x[:, 0]) + 0.1 * rng.normal(size=160)
    p = fit(x[:120], y[:120])(x[120:])
    assert np.mean((p - y[120:]) ** 2) < 0.6 * np.var(y[120:])


def test_lstm_learns_the_last_value():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6, 1))
    p = kernels.lstm(steps=300, rate=2e-2)(x[:90], x[:90, -1, 0])(x[90:])
    assert np.mean((p - x[90:, -1, 0]) ** 2) < 0.3


def test_pareto_tail_near_empirical():
    rng = np.random.default_rng(5)
    losses = rng.standard_t(4, 5000) * 0.01
    t = pareto_tails(losses[None])
    es, shape, n = t.es[0.05][0], t.shape[0], t.n[0]
    assert es == pytest.approx(-100 * np.sort(losses)[-250:].mean(), rel=0.08) and -0.2 < shape < 0.6 and n == 750


@given(st.lists(st.floats(0.01, 10), min_size=2, max_size=30))
@settings(max_examples=30, deadline=None)
def test_forward_splits_never_look_ahead(values):
    n = max(8, len(values))
    for train, test in kernels.forward_splits(n):
        assert train.max() < test.min() and test.max() < n
    assert math.isclose(sum(len(te) for _, te in kernels.forward_splits(n)), 3 * (n // 4))
