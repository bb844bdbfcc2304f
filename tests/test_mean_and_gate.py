"""Mean forecasts in levels, semivariance strategies, dynamic leverage, crisis windows and the gate, against NumPy and pandas."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import kernels
from factorloom.operators import forecast, race, replication, strategy
from factorloom.plans import catalogue, forecasting, registry  # noqa: F401

DATA = "/root/testdata/sf0.001"
TARGET = 0.12 / 12**0.5


def run(spark, name, data=DATA):
    return registry.QUERIES[name](spark, data).toPandas()


@pytest.fixture(scope="module")
def rows(spark):
    x = forecasting.race_features(spark, DATA).toPandas().sort_values(["series", "t"])
    return {series: own.reset_index(drop=True) for series, own in x.groupby("series")}


def ridge(own, target, level):
    out = np.full(len(own), np.nan)
    z, raw = own[forecast.HARX].to_numpy(), own[target].to_numpy()
    y = raw if level else np.log(raw)
    for t0 in range(race.FIRST, len(own), race.REFIT):
        te = np.arange(t0, min(t0 + race.REFIT, len(own)))
        p = kernels.standardised(kernels.ridge_loo)(z[:t0], y[:t0])
        rest = y[:t0] - p(z[:t0])
        out[te] = p(z[te]) if level else np.clip(np.exp(p(z[te]) + rest.var() / 2), raw[:t0].min() * 0.5, raw[:t0].max() * 2)
    return out


def sharpe(r):
    return 12**0.5 * r.mean() / r.std() if r.std() > 1e-12 else np.nan


def test_mean_forecast_in_levels(spark, rows):
    got = run(spark, "M17c_mean_in_levels").set_index("series")
    assert set(got.index) == set(rows)
    for series, own in rows.items():
        own = own[own.ret_next.notna()]
        mu, past = ridge(own, "ret_next", True), own.ret_next.expanding().mean().shift(1).to_numpy()
        r, oos = own.ret_next.to_numpy(), slice(race.FIRST, None)
        assert got.loc[series, "r2"] == pytest.approx((1 - ((r - mu)[oos] ** 2).sum() / ((r - past)[oos] ** 2).sum()) * 100, rel=1e-5, abs=1e-6)


def test_variance_or_semivariance(spark, rows):
    got = run(spark, "M17b_variance_or_semivariance").set_index(["series", "model"])
    for series, own in rows.items():
        down = own.x_down * own.rv
        own = own.assign(down_next=down.shift(-1).clip(lower=1e-8), half=down.rolling(6).mean().clip(lower=1e-8))
        own = own[down.shift(-1).notna()]
        oos = slice(race.FIRST, None)
        v = {"RW126": own.fvar, "RW-semi": 2 * own.half, "Ridge": ridge(own, "y", False), "Ridge-semi": 2 * ridge(own, "down_next", False)}
        for model, var in v.items():
            r = (TARGET / np.sqrt(np.asarray(var, dtype=float)) * own.ret_next.to_numpy())[oos]
            level = np.cumprod(1 + r)
            g = got.loc[(series, model)]
            assert g.n == len(r) and g.sharpe == pytest.approx(sharpe(r), rel=1e-5) and g.worst == pytest.approx(r.min() * 100, rel=1e-5)
            assert g.drawdown == pytest.approx((level / np.maximum.accumulate(level) - 1).min() * 100, rel=1e-5, abs=1e-9)


def test_dynamic_leverage_with_the_ridge_mean(spark, rows):
    got = run(spark, "T09r_mean_variance_ridge").set_index(["series", "model"])
    for series, own in rows.items():
        r, v, mu = own.ret_next.to_numpy(), own.fvar.to_numpy(), ridge(own, "ret_next", True)
        for model in ("mean", "ridge"):
            w = np.full(len(own), np.nan)
            for t0 in range(race.FIRST, len(own), race.REFIT):
                te = np.arange(t0, min(t0 + race.REFIT, len(own)))
                scale = TARGET * np.sqrt(v[:t0]).mean() / max(abs(r[:t0].mean()), 1e-9) / v[:t0].mean()
                w[te] = np.clip(scale * (mu[te] if model == "ridge" else r[:t0].mean()) / v[te], 0, 2)
            own_w = w[race.FIRST :]
            g = got.loc[(series, model)]
            assert g.lev == pytest.approx(own_w.mean(), rel=1e-5) and g.worst == pytest.approx((own_w * r[race.FIRST :]).min() * 100, rel=1e-5, abs=1e-9)


def test_twelve_models_in_every_market(spark):
    larger = DATA.replace("0.001", "0.01")  # the smallest tables have no market with enough days
    m21, losses = run(spark, "M21_markets", larger), run(spark, "M21b_market_losses", larger)
    assert m21.series.nunique() == 5
    models = {"ExpandingMean", "RW126", "EWMA", "HAR", "HARX", "Ridge", "Lasso", "RF", "HGB", "MLP", "LSTM", "ENS"}
    assert all(set(g.model) == models for _, g in m21.groupby("series")) and (m21.f > 0).all()
    assert m21.groupby(["series", "model"]).t.agg(lambda t: tuple(sorted(t))).groupby("series").nunique().eq(1).all()
    wide = m21.pivot_table(index=["series", "t"], columns="model", values="f")
    assert np.allclose(wide.ENS, wide[["HAR", "Ridge", "HGB"]].mean(axis=1))
    assert (losses[losses.model == "RW126"].gain.abs() < 1e-12).all()
    for _, g in losses.groupby("series"):
        assert g.sort_values("qlike").place.tolist() == list(range(1, len(g) + 1))


def test_crisis_windows(spark):
    month = lambda k: pd.Timestamp(2000 + k // 12, k % 12 + 1, 1).date().replace(day=28)
    strats = spark.createDataFrame([("s", m, t, month(t), 0.0, float(t + (m == "X"))) for t in range(24) for m in ("X", "plain")], "series string, model string, t long, month date, r double, lev double")
    r = spark.createDataFrame([("s", t, -0.11 if t in (3, 20) else -0.09) for t in range(24)], "series string, t long, ret_next double")
    got = {x.span: (x.n, x.lev, x.middle) for x in strategy.timing(strats, r, windows=[("w", "2000-01-01", "2000-06-30"), ("none", "1990-01-01", "1990-12-31")]).collect()}
    assert got == {"before falls": (2, 12.5, 12.5), "w": (6, 3.5, 3.5)}


def test_replication_gate(spark):
    """A factor with crashes that daily variance announces passes; the same months without warning do not."""
    rng = np.random.default_rng(3)
    days = [dt.date(2000, 1, 1) + dt.timedelta(i) for i in range(365 * 12)]
    months = sorted({(d.year, d.month) for d in days})
    wild = {m: m[0] % 4 == 3 for m in months}
    ends = {m: max(d for d in days if (d.year, d.month) == m) for m in months}
    daily = [("f", d, float(rng.normal(0, 0.04 if wild[(d.year, d.month)] else 0.004))) for d in days]
    monthly = [("f", ends[m], float(-0.55 if wild[m] and m[1] == 11 else rng.normal(0.025, 0.03))) for m in months]
    d, m = spark.createDataFrame(daily, "series string, date date, r double"), spark.createDataFrame(monthly, "series string, month date, r double")
    got = replication.gate(replication.managed(m, d), {"all": F.lit(True), "late": F.year("month") >= 2008}).toPandas().set_index("sample")
    x = pd.DataFrame(monthly, columns=["series", "month", "r"])
    q = pd.DataFrame(daily, columns=["series", "date", "r"])
    q["v"] = 21 * (q.r**2).rolling(126, min_periods=126).mean()
    known = q.dropna().groupby(q.date.map(lambda d: (d.year, d.month))).v.last()
    before = x.month.map(lambda d: known.get((d.year, d.month - 1) if d.month > 1 else (d.year - 1, 12), np.nan))
    x["star"] = TARGET / np.sqrt(before) * x.r
    for sample, own in (("all", x), ("late", x[x.month.map(lambda d: d.year >= 2008)])):
        g, r, s = got.loc[sample], own.r.to_numpy(), own.star.dropna().to_numpy()
        skew = lambda a: ((a - a.mean()) ** 3).mean() / a.std() ** 3
        assert g.n == len(r) and g.sharpe == pytest.approx(sharpe(r)) and g["skew"] == pytest.approx(skew(r)) and g.second_worst == pytest.approx(np.sort(r)[1] * 100)
        assert g.managed_sharpe == pytest.approx(sharpe(s)) and g.managed_skew == pytest.approx(skew(s))
        assert g.passes == (0.35 < sharpe(r) < 0.65 and skew(r) < -1 and sharpe(s) > 1.3 * sharpe(r) and r.min() < -0.5)
    assert got.loc["all", "passes"]
    none = replication.gate(replication.managed(m, d.limit(0)), {"all": F.lit(True)}).first()
    assert none.managed_sharpe is None and none.passes is False
