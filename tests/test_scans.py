"""Scans in blocks against plain loops over long series."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import calendar, race, reshape, rolling, scans
from factorloom.plans import catalogue, forecasting, measures, panels  # noqa: F401


def long_series(spark, n=100_000):
    rng = np.random.default_rng(3)
    rows = pd.concat([pd.DataFrame({"s": s, "t": np.arange(m), "v": rng.normal(size=m)}) for s, m in (("long", n), ("short", 5), ("blocks", 1024))])
    return rows, spark.createDataFrame(rows.sample(frac=1, random_state=1)).repartition(7)


@pytest.mark.parametrize("lam", [0.01, 0.7, 0.94])
def test_smoothing_of_long_series_equals_the_recursion(spark, lam):
    rows, df = long_series(spark)
    got = scans.smoothed(df.withColumn("lam", F.lit(lam)), ["s"], "t", "v", "lam", "f").toPandas().sort_values(["s", "t"])
    for s, own in rows.groupby("s"):
        v = own.v.to_numpy()
        want = np.empty(len(v))
        want[0] = v[:12].mean()
        for t in range(1, len(v)):
            want[t] = lam * want[t - 1] + (1 - lam) * v[t - 1]
        assert np.abs(got[got.s == s].f.to_numpy() - want).max() < 1e-12


def test_running_forms(spark):
    rows, df = long_series(spark, 5_000)
    rows["gap"] = rows.v.where((rows.t % 7 == 3) & (rows.t > 2))
    df = spark.createDataFrame(rows).withColumn("gap", F.when(~F.isnan("gap"), F.col("gap"))).repartition(5)
    got = scans.running_sum(scans.running_product(scans.filled(df, ["s"], "t", F.col("gap"), "last", 128), ["s"], "t", 1 + F.col("v") / 100, "level", 128), ["s"], "t", F.col("gap"), "total", 128)
    got = got.toPandas().sort_values(["s", "t"])
    for s, own in rows.groupby("s"):
        mine = got[got.s == s]
        assert np.allclose(mine.level, (1 + own.v / 100).cumprod(), rtol=1e-12) and np.allclose(mine.total, own.gap.fillna(0).cumsum(), atol=1e-9)
        assert np.array_equal(mine["last"].to_numpy(float), own.gap.ffill().to_numpy(), equal_nan=True)


def test_three_levels_and_a_series_that_is_too_long(spark):
    df = spark.range(1000).selectExpr("id AS t", "1.0D AS v")
    assert scans.composed(df, [], "t", F.lit(1.0), F.col("v"), block=16, levels=3).agg(F.max("_b")).first()[0] == 1000
    with pytest.raises(Exception, match="longer than the levels"):
        scans.composed(df, [], "t", F.lit(1.0), F.col("v"), block=16, levels=2).agg(F.max("_b")).first()


def test_overlapping_windows_equal_one_window(spark):
    rng = np.random.default_rng(5)
    v = pd.Series(rng.normal(size=3000))
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(1, 3001), "v": v})).repartition(6)
    got = scans.overlapping(df, "t", 50, 128).withColumn("m", F.sum("v").over(rolling.trailing(["_block"], "t", 50))).where("_own").toPandas().sort_values("t")
    assert len(got) == 3000 and np.allclose(got.m, v.rolling(50, min_periods=1).sum())
    with pytest.raises(ValueError, match="as long"):
        scans.overlapping(df, "t", 50, 49)


def test_ordinals_over_blocks_of_the_calendar(spark):
    rng = np.random.default_rng(6)
    days = sorted({dt.date(1969, 1, 1) + dt.timedelta(int(k)) for k in rng.integers(0, 20_000, 6_000)})
    df = spark.createDataFrame([(d,) for d in days[::-1] * 2] + [(None,)], "d date")
    got = {r.d: r.n for r in calendar.ordinals(df, "d", "n").collect()}
    assert got == {d: k + 1 for k, d in enumerate(days)}
    assert calendar.ordinals(df.limit(0), "d", "n").count() == 0


def test_alignment_and_carrying(spark):
    days = spark.range(1, 11).selectExpr("id AS di", "date_add(DATE '2020-01-01', CAST(id AS INT)) AS date")
    rows = [("a", 2, 1.0), ("a", 3, None), ("a", 5, 2.0), ("b", 10, 3.0), ("c", 4, None), ("d", 1, 4.0)]
    panel = spark.createDataFrame(rows, "code string, di long, x double")
    frame = pd.DataFrame(rows, columns=["code", "di", "x"]).pivot(index="di", columns="code", values="x").reindex(range(1, 11))
    by = lambda df: {(r.code, r.di): r.x for r in df.collect()}
    want = lambda f: {(c, d): None if np.isnan(v) else v for c in f for d, v in f[c].items()}
    assert by(reshape.aligned(panel, days, "code", "di")) == want(frame) and by(reshape.carried(panel, days, "code", "di", "x")) == want(frame.ffill())


@pytest.mark.parametrize("query", [panels.c09, measures.w05, measures.w17, forecasting.m16, panels.s14])
def test_no_window_without_a_partition(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Window " in line or "+- Window" in line:
            assert "windowspecdefinition(" in line and all(not part.split(",")[0].endswith(("ASC NULLS FIRST", "DESC NULLS LAST")) for part in line.split("windowspecdefinition(")[1:]), line


def test_recursion_of_the_race(spark):
    y = [0.3, 0.1, 0.5, 0.2, 0.9, 0.4, 0.7]
    df = spark.createDataFrame([("s", t, v) for t, v in enumerate(y)], "series string, t long, y double")
    assert {r.t for r in race.ewmas(df).collect()} == set(range(7))
