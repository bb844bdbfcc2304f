"""Least squares in columns against a plain solver."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import regression


@pytest.mark.parametrize("k", [1, 3, 5])
def test_coefficients_and_t_values(spark, k):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(400, k)) * 10.0 ** rng.integers(-3, 3, k) + rng.normal(size=k) * 5
    frame = pd.DataFrame(x, columns=[f"v{i}" for i in range(k)]).assign(g=np.where(np.arange(400) < 250, "a", "b"), y=x @ rng.normal(size=k) + rng.normal(size=400) + 3)
    df = spark.createDataFrame(frame).repartition(5)
    got = {(r.g, r.term): r for r in regression.least_squares(df, F.col("y"), {f"v{i}": F.col(f"v{i}") for i in range(k)}, ["g"]).collect()}
    for g, own in frame.groupby("g"):
        z = np.column_stack([np.ones(len(own)), own[[f"v{i}" for i in range(k)]]])
        beta = np.linalg.lstsq(z, own.y, rcond=None)[0]
        e = own.y - z @ beta
        t = beta / np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * (e @ e) / (len(own) - k - 1))
        for name, b, s in zip(["const", *(f"v{i}" for i in range(k))], beta, t):
            assert got[g, name].beta == pytest.approx(b, rel=1e-7, abs=1e-9) and got[g, name].t == pytest.approx(s, rel=1e-6) and got[g, name].n == len(own)


def test_dependent_regressors_and_few_rows(spark):
    rows = [("same", float(k), 2.0 * k, 1.0 + k) for k in range(9)] + [("flat", 1.0, float(k), 2.0) for k in range(9)] + [("few", 1.0, 2.0, 3.0), ("few", 2.0, 1.0, 3.5), ("nulls", None, 1.0, 1.0), ("exact", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double")
    got = regression.least_squares(df, F.col("y"), {"a": F.col("a"), "b": F.col("b")}, ["g"]).collect()
    assert {r.g for r in got} == {"same", "flat", "few", "exact"} and all(r.beta is None and r.t is None for r in got)
    assert regression.least_squares(df.limit(0), F.col("y"), {"a": F.col("a")}, ["g"]).count() == 0
