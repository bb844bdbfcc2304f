"""The cost of the race's steps: forests grown by levels give the trees of plain recursion, replicates are dealt over tasks, no model is fitted twice."""

from __future__ import annotations

import os
import time

import numpy as np
from pyspark.sql import functions as F

from factorloom.functions import kernels
from factorloom.operators import bootstrap as bs
from factorloom.operators import forecast


def plain_tree(x, y, depth, leaf):
    """A regression tree by recursion, one node and column at a time."""

    def grow(rows, level):
        value = y[rows].mean()
        if level == depth or len(rows) < 2 * leaf:
            return value
        best = (1e-12, None, None)
        for j in range(x.shape[1]):
            order = rows[np.argsort(x[rows, j], kind="stable")]
            v, left = x[order, j], np.cumsum(y[order] - value)[:-1]
            n = np.arange(1, len(rows))
            gain = left**2 / n + left**2 / (len(rows) - n)
            gain[(v[1:] == v[:-1]) | (n < leaf) | (len(rows) - n < leaf)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, (v[k] + v[k + 1]) / 2)
        if best[1] is None:
            return value
        go = x[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[go], level + 1), grow(rows[~go], level + 1)

    root = grow(np.arange(len(y)), 0)

    def one(row):
        at = root
        while isinstance(at, tuple):
            at = at[2] if row[at[0]] <= at[1] else at[3]
        return at

    return lambda z: np.array([one(r) for r in z])


def plain_forest(x, y, trees, depths=(3, 5, 30), leaves=(5, 10), seed=42):
    def bag(x, y, depth, leaf):
        rng = np.random.default_rng(seed)
        own = [plain_tree(x[i], y[i], depth, leaf) for i in (rng.integers(0, len(y), len(y)) for _ in range(trees))]
        return lambda z: np.mean([t(z) for t in own], axis=0)

    loss = {(d, m): sum(((y[te] - bag(x[tr], y[tr], d, m)(x[te])) ** 2).mean() for tr, te in kernels.forward_splits(len(y))) for d in depths for m in leaves}
    return bag(x, y, *min(loss, key=loss.get))


def test_forest_by_levels_is_the_plain_forest_and_much_cheaper(monkeypatch):
    rng = np.random.default_rng(5)
    for n, ties in ((66, False), (41, True), (23, True), (300, False)):
        x = rng.normal(size=(n, 5))
        x = np.round(x, 0 if ties else 9)
        y, z = x[:, 0] * x[:, 1] + rng.normal(size=n), rng.normal(size=(7, 5))
        start = time.process_time()
        plain = plain_forest(x, y, 40)
        middle = time.process_time()
        ours = kernels.forest(40)(x, y)
        end = time.process_time()
        assert np.array_equal(ours(z), plain(z)) and np.array_equal(ours(x), plain(x))
        assert end - middle < (middle - start) / 2
    monkeypatch.setattr(kernels, "STEP_ENTRIES", 500)  # nodes in many steps give the same trees
    assert np.array_equal(kernels.forest(40)(x, y)(z), plain(z))


def test_forest_of_a_constant_is_the_constant():
    assert (kernels.forest(5)(np.ones((30, 2)), np.full(30, 2.5))(np.zeros((3, 2))) == 2.5).all()


def test_replicates_are_dealt_over_tasks(spark):
    """They come from one row a series, which one task holds."""
    table = spark.createDataFrame([(s, m, t, 0.01 * ((t * 7 + len(m)) % 11) - 0.03) for s in ("a", "b") for m in ("x", "yy", "zzz") for t in range(36, 66)], "series string, model string, t long, r double")
    drawn = bs.drawn(table, 200, 36).withColumn("task", F.spark_partition_id())
    tasks = drawn.groupBy("task").agg(F.count("*").alias("n")).toPandas().n
    assert tasks.sum() == 2 * 3 * 200
    assert len(tasks) >= 2 * spark.sparkContext.defaultParallelism and tasks.max() <= tasks.sum() / spark.sparkContext.defaultParallelism


def test_markets_fit_each_model_once(spark, monkeypatch, tmp_path):
    """The ensemble reads the written forecasts; every (market, fold, model) leaves one line."""
    from factorloom.plans import forecasting

    data, log = tmp_path / "tables", str(tmp_path / "fits")
    os.symlink("/root/testdata/sf0.01", data)  # another path, so that no view of it stands yet

    def noted(name):
        def fit(x, y):
            with open(log, "a") as f:
                f.write(f"{name} {len(y)} {y.sum()!r}\n")
            return kernels.ols(x, y)

        return fit

    monkeypatch.setattr(forecast, "ESTIMATORS", {m: (forecast.HAR, noted(m)) for m in ("HAR", "Ridge", "HGB")})
    got = forecasting.m21(spark, str(data)).toPandas()
    assert {"HAR", "Ridge", "HGB", "LSTM", "RW126", "ENS"} <= set(got.model)
    fits = open(log).read().splitlines()
    assert len(fits) == len(set(fits)) and len(fits) > 3 * got.series.nunique()
