"""Queries that no SQL repeats, against plain NumPy and pandas."""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import zipfile
from pathlib import Path
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from factorloom.functions import kernels
from factorloom.functions.tails import pareto_tails
from factorloom.operators import bootstrap, forecast, race
from factorloom.plans import catalogue, forecasting, inference, registry  # noqa: F401
from factorloom.sources import catalog as c
from factorloom.sources import shared, workbook

DATA = "/root/testdata/sf0.001"
MODELS = {"ExpandingMean", "RW126", "EWMA", "HAR", "HARX", "Ridge", "Lasso", "RF", "HGB", "MLP", "LSTM", "ENS"}


def run(spark, name):
    return registry.QUERIES[name](spark, DATA).toPandas()


@pytest.fixture(scope="module")
def rows(spark):
    return forecasting.race_features(spark, DATA).toPandas().sort_values(["series", "t"])


@pytest.fixture(scope="module")
def scored(spark):
    s = inference.scored(spark, DATA, forecasting.whole_race).toPandas().sort_values(["series", "model", "t"])
    return s[s.f.notna()]


def test_twelve_models_meet_in_the_same_months(scored):
    assert set(scored.model) == MODELS
    months = scored.groupby(["series", "model"]).t.agg(lambda t: tuple(t))
    assert all(own.nunique() == 1 for _, own in months.groupby("series"))


def test_ensemble_is_the_mean_of_three(scored):
    wide = scored.pivot_table(index=["series", "t"], columns="model", values="f")
    assert np.allclose(wide.ENS, wide[["HAR", "Ridge", "HGB"]].mean(axis=1))


@pytest.mark.parametrize(("model", "columns"), [("HAR", forecast.HAR), ("HARX", forecast.HARX)])
def test_least_squares_forecasts(rows, scored, model, columns):
    for series, own in rows.groupby("series"):
        got = scored[(scored.series == series) & (scored.model == model)].set_index("t").f
        for t0 in range(race.FIRST, int(own.t.max()) + 1, race.REFIT):
            train, test = own[own.t < t0], own[(own.t >= t0) & (own.t < t0 + race.REFIT)]
            x = lambda d: np.column_stack([np.ones(len(d)), d[columns]])
            beta = np.linalg.lstsq(x(train), np.log(train.y), rcond=None)[0]
            rest = np.log(train.y) - x(train) @ beta
            assert np.allclose(got[test.t], np.exp(x(test) @ beta + rest.to_numpy().var() / 2), rtol=1e-5)


def test_leaderboard_of_the_race(spark, scored):
    got = run(spark, "K01r_leaderboard_race").set_index(["series", "model"])
    for series, own in scored.groupby("series"):
        by = {m: g.set_index("t") for m, g in own.groupby("model")}
        base = by["RW126"]
        sse = ((base.y - by["ExpandingMean"].f) ** 2).sum()
        for m, g in by.items():
            r = got.loc[series, m]
            loss = lambda g: g.y / g.f - np.log(g.y / g.f) - 1
            assert r.qlike == pytest.approx(loss(g).mean()) and r.n == len(g)
            assert r.oos_r2 == pytest.approx((1 - ((g.y - g.f) ** 2).sum() / sse) * 100, rel=1e-6, abs=1e-6)
            if m == "RW126":
                assert np.isnan(r.dm)
                continue
            d = (loss(g) - loss(base)).to_numpy()
            v = d.var() + sum(2 * (1 - k / 4) * np.cov(d[k:], d[:-k])[0, 1] for k in (1, 2, 3))
            if v > 0:
                stat = d.mean() / np.sqrt(v / len(d))
                assert r.dm == pytest.approx(stat, rel=1e-5) and r.p == pytest.approx(2 * (1 - NormalDist().cdf(abs(stat))), abs=1e-6)


def test_adjusted_gaps_and_sharpe_gaps(spark, scored):
    cw, jk = (run(spark, k).set_index(k0) for k, k0 in (("K03r_clark_west_race", ["series", "model"]), ("K07r_sharpe_gap_race", "key")))
    own = scored[scored.series == "wml"]
    by = {m: g.set_index("t") for m, g in own.groupby("model")}
    b = by["RW126"]
    for m in sorted(MODELS - {"RW126"}):
        g = by[m]
        adj = (g.y - b.f) ** 2 - ((g.y - g.f) ** 2 - (b.f - g.f) ** 2)
        t = adj.mean() / (adj.std(ddof=0) / np.sqrt(len(adj)))
        assert cw.loc[("wml", m), "t"] == pytest.approx(t) and cw.loc[("wml", m), "p"] == pytest.approx(1 - NormalDist().cdf(t), abs=1e-9)
        x, y = (g.lev * g.ret_next).to_numpy(), (b.lev * b.ret_next).to_numpy()
        s1, s0, rho = x.mean() / x.std(), y.mean() / y.std(), np.corrcoef(x, y)[0, 1]
        z = (s1 - s0) / np.sqrt((2 - 2 * rho + 0.5 * (s1**2 + s0**2 - 2 * s1 * s0 * rho**2)) / len(x))
        assert jk.loc[f"wml-{m}", "z"] == pytest.approx(z, rel=1e-6)


def test_interaction_regression(spark):
    from factorloom.plans.measures import bears

    b = bears(spark, DATA).toPandas().sort_values(["series", "month"])
    got = inference.k06(spark, DATA).toPandas().set_index(["series", "term"])
    for series, g in b.groupby("series"):
        g = g.assign(y=g.ret.shift(-1)).dropna(subset=["y"])
        x = np.column_stack([np.ones(len(g)), g.rv, g.bear, g.rv * g.bear])
        own = got.loc[series].loc[["const", "rv", "bear", "rv_bear"]]
        scaled = x / np.maximum(np.abs(x).max(axis=0), 1e-300)
        if np.linalg.matrix_rank(scaled, tol=1e-9) < 4:  # no bear months, or one
            assert own.beta.isna().all() and own.t.isna().all()
            continue
        q, r = np.linalg.qr(scaled)
        inverse = np.linalg.inv(r)
        beta = inverse @ (q.T @ g.y)
        e = g.y - scaled @ beta
        t = beta / np.sqrt((inverse**2).sum(axis=1) * (e @ e) / (len(g) - 4))
        assert np.allclose(own.beta * np.abs(x).max(axis=0), beta, rtol=1e-6) and np.allclose(own.t, t, rtol=1e-6)


def test_deflated_ratio(spark):
    s = inference.strats(spark, DATA).toPandas()
    got = run(spark, "K16_deflated_sharpe").set_index(["series", "trials"])
    n01 = NormalDist()
    for series, own in s.groupby("series"):
        each = {m: g.r.to_numpy() for m, g in own.groupby("model")}
        ratio = {m: r.mean() / r.std() for m, r in each.items()}
        best = max(ratio, key=ratio.get)
        r, sr = each[best], ratio[best]
        z = (r - r.mean()) / r.std()
        for trials, n in (("models", len(each)), ("12", 12), ("40", 40)):
            sr0 = np.sqrt(np.var(list(ratio.values()))) * ((1 - np.euler_gamma) * n01.inv_cdf(1 - 1 / n) + np.euler_gamma * n01.inv_cdf(1 - 1 / (n * np.e)))
            want = n01.cdf((sr - sr0) * np.sqrt(len(r) - 1) / np.sqrt(1 - (z**3).mean() * sr + ((z**4).mean() - 1) / 4 * sr**2))
            assert got.loc[(series, trials), "dsr"] == pytest.approx(want, abs=1e-9) and got.loc[(series, trials), "model"] == best


def test_tails_of_replicates(spark, monkeypatch):
    monkeypatch.setattr(inference, "TAIL_REPS", 40)
    got = inference.k18(spark, DATA).toPandas().set_index(["series", "model", "level"])
    s = inference.strats(spark, DATA).toPandas()
    n = inference.strats(spark, DATA).groupBy("series").agg({"t": "max"}).selectExpr("series", f"`max(t)` - {race.FIRST} + 1 as n")
    index = bootstrap.block_index(n, 40).toPandas().sort_values(["series", "b", "pos"])
    own = {m: g.sort_values("t").r.to_numpy() for m, g in s[s.series == "wml"].groupby("model")}
    gaps = []
    for _, g in index[index.series == "wml"].groupby("b"):
        es = {m: pareto_tails(-own[m][g.i.to_numpy()][None], least=inference.LEAST_EXCEEDANCES).es[0.05][0] for m in ("plain", "RW126")}
        gaps.append(es["plain"] - es["RW126"])
    gaps = np.array(gaps)[~np.isnan(gaps)]
    assert len(gaps) > 20
    assert got.loc[("wml", "plain", "es5"), "boot_mean"] == pytest.approx(gaps.mean(), rel=1e-9)
    assert got.loc[("wml", "plain", "es5"), "p_le0"] == pytest.approx((gaps <= 0).mean())


def one_fold(own, columns, target, fit, transform, t0):
    train, test = own[own.t < t0], own[(own.t >= t0) & (own.t < t0 + race.REFIT)]
    p = fit(train[columns].to_numpy(), np.log(train[target].to_numpy()))
    y = train[target].to_numpy()
    return test.t, forecast.back(p(test[columns].to_numpy()), np.log(y) - p(train[columns].to_numpy()), y, transform)


def test_downside_targets(spark, rows):
    got = run(spark, "M17_semivariance_target").set_index(["series", "t"]).f
    for series, own in rows.groupby("series"):
        own = own.assign(down_next=(own.x_down * own.rv).shift(-1).clip(lower=1e-8)).dropna(subset=["down_next"])
        t, f = one_fold(own, forecast.HARX, "down_next", kernels.standardised(kernels.ridge_loo), "smear", race.FIRST)
        assert np.allclose(got[series][t], f, rtol=1e-6)


def test_components_and_markets(spark):
    m16, m21 = run(spark, "M16_component_forecasts"), run(spark, "M21_markets")
    assert set(m16.series) == {"market", "specific"} and (m16.f > 0).all()
    x = forecast.features(c.market_day(spark, DATA).withColumnRenamed("market", "series")).toPandas().sort_values(["series", "t"])
    got = m21[m21.model == "Ridge"].set_index(["series", "t"]).f
    for series, own in x.groupby("series"):
        if own.t.max() < race.FIRST:
            continue
        t, f = one_fold(own, forecast.HARX, "y", kernels.standardised(kernels.ridge_loo), "clip", race.FIRST)
        assert np.allclose(got[series][t], f, rtol=1e-6)


def test_crash_overlay_and_auc(spark, rows):
    p = run(spark, "M18_crash_classifier")
    auc = run(spark, "M18b_auc").set_index(["series", "model"]).auc
    for key, g in p.groupby(["series", "model"]):
        a, b = g.p[g.hit == 1].to_numpy(), g.p[g.hit == 0].to_numpy()
        if len(a) and len(b):
            assert auc[key] == pytest.approx(((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2))
    t14 = run(spark, "T14_crash_overlay").set_index(["series", "model"]).sharpe
    j = p.merge(rows[["series", "t", "fvar", "ret_next"]], on=["series", "t"])
    j["r"] = race.TARGET / np.sqrt(12) / np.sqrt(j.fvar) * (1 - j.p).clip(0.2, 1) * j.ret_next
    for key, g in j.groupby(["series", "model"]):
        assert t14[key] == pytest.approx(np.sqrt(12) * g.r.mean() / g.r.std())


def test_importance_and_starts(spark, rows):
    got = run(spark, "M19_importance").set_index(["series", "feature"]).importance
    own, parts = rows[rows.series == "wml"], []
    for t0 in range(race.FIRST, int(own.t.max()) + 1, race.REFIT):
        train = own[own.t < t0]
        x, y = train[forecast.HARX].to_numpy(), np.log(train.y.to_numpy())
        m, s = x.mean(axis=0), x.std(axis=0)
        p = kernels.standardised(kernels.ridge_loo)(x, y)
        parts.append([abs(p((m + s * (np.arange(len(m)) == j))[None])[0] - p(m[None])[0]) for j in range(len(m))])
    assert np.allclose(got["wml"][forecast.HARX], np.mean(parts, axis=0), rtol=1e-6)
    starts = run(spark, "M20_training_start")
    assert set(starts.model) == {"HAR", "HARX unlogged"} and set(starts["first"]) == {36, 48}


def test_seed_sweep(spark):
    got = run(spark, "M13_seed_sweep")
    assert set(got.model) == {"MLP", "LSTM"} and (got.least <= got["mean"]).all() and (got["mean"] <= got.most).all()


def test_six_constructions(spark):
    assert set(run(spark, "T07_construction_grid").variant) == {"base", "quintiles", "equal", "one market", "large", "no skip"}
    got = run(spark, "T07r_construction_grid_ridge")
    assert len(got) == 6 and (got.worst < 0).all()


def test_fingerprints_against_the_manifest(spark):
    got = run(spark, "S16_fingerprint").set_index("name")
    for p in Path(DATA).glob("*.parquet"):
        r = got.loc[p.name]
        assert r.sha256 == hashlib.sha256(p.read_bytes()).hexdigest() and r.bytes == p.stat().st_size and r.state in ("new", "same")


def test_workbook_header_is_found_by_its_marks():
    header = [dt.date(1999, 1, 15), dt.date(1999, 1, 29), dt.date(1999, 2, 26)]
    content = workbook.document(header, [("A1", [1.0, 2.0, None]), ("B&2", [None, -1.0, 3.5])])
    assert list(workbook.long_rows(content, "Code", "Name")) == [("A1", header[1], 2.0), ("B&2", header[2], 3.5)]
    assert list(workbook.long_rows(content, "Code", "Absent")) == []
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as a, zipfile.ZipFile(out, "w") as b:  # the same with shared strings
        sheet = a.read(workbook.SHEET).decode().replace('t="inlineStr"><is><t>A1</t></is>', 't="s"><v>0</v>')
        b.writestr(workbook.SHEET, sheet)
        b.writestr("xl/styles.xml", a.read("xl/styles.xml"))
        b.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>Z</t></r><r><t>9</t></r></si></sst>')
    assert next(workbook.long_rows(out.getvalue(), "Code", "Name"))[0] == "Z9"


def test_views_are_written_anew_when_a_table_changes(spark, tmp_path):
    seen = []

    @shared.saved("t")
    def view(s, d):
        seen.append(d)
        return s.read.parquet(f"{d}/t.parquet").selectExpr("sum(id) as total")

    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert view(spark, str(tmp_path)).first().total == view(spark, str(tmp_path)).first().total == 3 and len(seen) == 1
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert view(spark, str(tmp_path)).first().total == 13 and len(seen) == 2


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        shared.new_path(Session())


def test_recursion_in_closed_form(spark):
    y = [0.3, 0.1, 0.5, 0.2, 0.9, 0.4, 0.7]
    df = spark.createDataFrame([("s", t, v) for t, v in enumerate(y)], "series string, t long, y double")
    got = race.ewmas(df).toPandas()
    for lam, g in got.groupby("lam"):
        s, want = np.mean(y), []
        for v in y:
            want.append(s)
            s = lam * s + (1 - lam) * v
        assert np.allclose(g.sort_values("t").f, want)


def test_placebo_factors_of_the_race(spark):
    got = run(spark, "K24br_placebo_tails_race").set_index(["series", "model"])
    s = inference.strats(spark, DATA, inference.whole_placebos).toPandas()
    assert set(s.series) == {"wml", "mkt", "smb", "hml"} and {"Ridge", "HGB", "ENS", "RW126", "plain"} <= set(s.model)
    tail = lambda r: np.sort(r)[: max(1, int(0.05 * len(r)))].mean() * 100
    es = s.groupby(["series", "model"]).r.agg(tail)
    ratio = s.groupby(["series", "model"]).r.agg(lambda r: np.sqrt(12) * r.mean() / r.std(ddof=0))
    assert set(got.index) == {k for k in es.index if k[1] != "plain"}
    for (series, model), row in got.iterrows():
        base = "plain" if model == "RW126" else "RW126"
        assert row.base == base and row.d_es == pytest.approx(es[series, model] - es[series, base], rel=1e-9, abs=1e-12) and row.d_sharpe == pytest.approx(ratio[series, model] - ratio[series, base], rel=1e-9, abs=1e-12) and 0 <= row.p_le0 <= 1


def test_statistics_of_replicates_by_numpy(spark):
    """Every statistic of the first replicates of the whole race, drawn and computed by NumPy."""
    from factorloom.plans.forecasting import whole_race

    got = inference.stats(spark, DATA, whole_race).where("series = 'wml' and b < 5").toPandas().set_index(["b", "model"])
    s = inference.strats(spark, DATA, whole_race).toPandas()
    own = {m: g.sort_values("t").r.to_numpy() for m, g in s[s.series == "wml"].groupby("model")}
    n = len(own["plain"])
    for b in range(5):
        starts = [int(hashlib.md5(f"42-{b}-{j}".encode()).hexdigest()[:8], 16) % n for j in range(-(-n // 12))]
        at = np.concatenate([(k + np.arange(12)) % n for k in starts])[:n]
        for m, r in own.items():
            x, row = r[at], got.loc[(b, m)]
            z = (x - x.mean()) / x.std()
            want = {"sharpe": np.sqrt(12) * x.mean() / x.std(), "skew": (z**3).mean(), "worst": x.min() * 100, "es": np.sort(x)[: max(1, int(0.05 * n))].mean() * 100, "mv": (x.mean() - 2.5 * x.var()) * 1200}
            for name, value in want.items():
                assert row[name] == pytest.approx(value, rel=1e-8), name
            if (1 + x > 0).all():
                assert row.crra == pytest.approx((((1 + x) ** -9.0).mean() ** (12 / -9) - 1) * 100, rel=1e-8)
            else:
                assert np.isnan(row.crra)
