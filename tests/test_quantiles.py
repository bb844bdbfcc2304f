"""Selection in bins against NumPy's quantiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import quantiles, sorts

AT = [0.0, 0.01, 0.3, 0.5, 0.7, 0.999, 1.0]


def groups():
    rng = np.random.default_rng(4)
    return {"normal": rng.normal(size=5001), "tail": np.exp(rng.normal(size=4000) * 6), "far": np.append(rng.normal(size=3000), [1e300, -1e300]), "ties": np.repeat([1.0, 2.0, 3.0], [10, 2000, 7]), "one": np.array([5.0]), "same": np.full(50, -2.0), "whole": rng.integers(0, 9, 800).astype(float)}


@pytest.mark.parametrize(("bins", "levels"), [(4096, 2), (8, 1), (8, 3)])
def test_quantiles_of_groups(spark, bins, levels):
    frame = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in groups().items()])
    df = spark.createDataFrame(frame).unionByName(spark.createDataFrame([("none", None), ("one", None)], "g string, v double")).repartition(6)
    got = {(r.g, r.q): r.value for r in quantiles.exact_quantiles(df, "v", AT, ["g"], bins, levels).collect()}
    assert {g for g, _ in got} == set(groups())
    for g, v in groups().items():
        assert [got[g, q] for q in AT] == pytest.approx(np.quantile(v, AT).tolist(), rel=1e-12)


def test_ten_million_values_of_one_group(spark):
    n = 10_000_000
    df = spark.range(n, numPartitions=8).select(((F.col("id") * 7_919) % n / 1000).alias("v"))
    got = {r.q: r.value for r in quantiles.exact_quantiles(df, "v", [0.1, 0.5, 0.975], []).collect()}
    assert got == pytest.approx({q: q * (n - 1) / 1000 for q in (0.1, 0.5, 0.975)}, rel=1e-12)


def test_buckets_are_those_of_small_groups(spark):
    frame = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in groups().items()])
    frame["i"] = np.arange(len(frame))
    df = spark.createDataFrame(frame)
    large = {r.i: r.bucket for r in quantiles.large_group_buckets(df, "v", 5, ["g"]).collect()}
    small = {r.i: r.bucket for r in sorts.quantile_buckets(df, "v", 5, ["g"]).collect()}
    assert large == small
