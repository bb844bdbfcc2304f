"""Expanding-window forecasts: every (series, fold) is one group, fitted by a NumPy kernel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.functions import histograms, kernels
from factorloom.operators import race, rolling

HAR = ["x_rv1", "x_rv3", "x_rv12"]
HARX = [*HAR, "x_down", "x_fvar", "x_ret", "x_bear", "x_draw"]

#: Name of each estimator: its columns and how it is fitted to logarithms.
ESTIMATORS: dict[str, tuple[list[str], Callable]] = {
    "HAR": (HAR, kernels.ols),
    "HARX": (HARX, kernels.ols),
    "Ridge": (HARX, kernels.standardised(kernels.ridge_loo)),
    "Lasso": (HARX, kernels.standardised(kernels.lasso_cv)),
    "RF": (HARX, kernels.forest()),
    "HGB": (HARX, histograms.regressor()),
    "MLP": (HARX, kernels.standardised(kernels.mlp())),
}

#: Name of each classifier and how it is fitted.
CLASSIFIERS: dict[str, Callable] = {"Logit": kernels.standardised(kernels.logistic), "HGBc": histograms.classifier()}


def features(series_day: DataFrame) -> DataFrame:
    """Race rows with logarithmic volatility terms and states, all non-null, t counted anew."""
    m = race.months(series_day)
    by, o = ["series"], W.partitionBy("series").orderBy("month")
    w = lambda n: rolling.trailing(by, "month", n)
    m = m.withColumn("y", F.lead("rv").over(o)).withColumn("ret_next", F.lead("ret").over(o)).withColumn("level", rolling.index_level("ret", by, "month"))
    m = m.join(race.variance_features(series_day), ["series", "month"]).where("y > 0 and rv > 0")
    x = m.select(
        "series", "month", "y", "ret", "rv", "fvar", "ret_next", F.ln("rv").alias("x_rv1"), F.ln(rolling.full(F.avg("rv"), "rv", w(3), 3)).alias("x_rv3"), F.ln(rolling.full(F.avg("rv"), "rv", w(12), 12)).alias("x_rv12"),
        F.try_divide("down", "rv").alias("x_down"), F.ln("fvar").alias("x_fvar"), F.col("ret").alias("x_ret"), F.expr("double(ret < 0)").alias("x_bear"), rolling.drawdown("level", by, "month").alias("x_draw"),
    ).dropna()
    return x.withColumn("t", (F.row_number().over(o) - 1).cast("long"))


def fold_rows(x: DataFrame, first: int = race.FIRST, refit: int = race.REFIT, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """Rows of every fold they train or are forecast in: column t0. Each row names its folds itself; nothing is joined."""
    last = F.max("t").over(W.partitionBy(*by))
    low = F.greatest(F.lit(first), first + refit * F.floor((F.col("t") - first) / refit)).cast("int")
    each = x.withColumn("_last", last.cast("int")).where(F.col("_last") >= low)
    return each.withColumn("t0", F.explode(F.sequence(low, F.col("_last"), F.lit(refit)))).drop("_last")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups dealt over four tasks a core: they hold few rows but much work, so they may not be merged by size."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def back(prediction: np.ndarray, residual: np.ndarray, y: np.ndarray, transform: str) -> np.ndarray:
    """From logarithms to variances: with log-normal smearing, or clipped to half the least and twice the most, or both; `level` leaves levels."""
    if transform == "level":
        return prediction
    if transform == "smear":
        return np.exp(np.clip(prediction + residual.var() / 2, -50, 50))
    if transform not in ("clip", "smear and clip"):
        raise ValueError(f"no transform {transform}")
    shift = residual.var() / 2 if transform == "smear and clip" else 0.0
    return np.exp(np.clip(prediction + shift, np.log(y.min() * 0.5), np.log(y.max() * 2)))


def run(x: DataFrame, models: list[str], transform: str = "smear", target: str = "y", by: tuple[str, ...] = ("series",), first: int = race.FIRST, refit: int = race.REFIT, estimators: dict | None = None) -> DataFrame:
    """Forecasts (by, t, model, f) of the models, fitted in parallel by series, fold and model.

    Targets are fitted as logarithms, with the transform `level` as they are.
    """
    own = {k: (estimators or ESTIMATORS)[k] for k in models}
    columns = sorted({c for cols, _ in own.values() for c in cols})
    keys = list(by)
    types = dict(x.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", t long, model string, f double"

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        *names, t0, model = key
        rows = rows.sort_values("t")
        cols, estimator = own[model]
        train, test = rows[rows.t < t0], rows[(rows.t >= t0) & (rows.t < t0 + refit)]
        y = train[target].to_numpy()
        fitted = y if transform == "level" else np.log(y)
        p = estimator(train[cols].to_numpy(), fitted)
        f = back(p(test[cols].to_numpy()), fitted - p(train[cols].to_numpy()), y, transform)
        return pd.DataFrame({**dict(zip(keys, names, strict=True)), "t": test.t.to_numpy(), "model": model, "f": f})

    folds = fold_rows(x.select(*keys, "t", F.col(target), *columns), first, refit, by).withColumn("model", F.explode(F.array(*map(F.lit, models))))
    return spread(folds.where((F.col("t") < F.col("t0") + refit)), *keys, "t0", "model").groupBy(*keys, "t0", "model").applyInPandas(fit, schema)


def run_lstm(x: DataFrame, columns: list[str], length: int = 12, seeds: tuple[int, ...] = (42,), first: int = race.FIRST, refit: int = race.REFIT, transform: str = "smear") -> DataFrame:
    """Forecasts of the recurrent network from the rows t - length .. t - 1; the seed is part of the key."""

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        series, t0, seed = key
        rows = rows.sort_values("t")
        z, y, t = rows[columns].to_numpy(), np.log(rows.y.to_numpy()), rows.t.to_numpy()
        m, s = z[t < t0].mean(axis=0), z[t < t0].std(axis=0)
        z = (z - m) / np.where(s > 0, s, 1)
        at = np.arange(length, len(z))
        seqs = np.stack([z[i - length : i] for i in at])
        train = t[at] < t0
        p = kernels.lstm(seed=int(seed))(seqs[train], y[at][train])
        f = back(p(seqs[~train]), y[at][train] - p(seqs[train]), np.exp(y[at][train]), transform)
        return pd.DataFrame({"series": series, "t": t[at][~train], "model": f"LSTM{seed}", "f": f})

    folds = fold_rows(x.select("series", "t", "y", *columns), first, refit).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    return spread(folds.where(F.col("t") < F.col("t0") + refit), "series", "t0", "seed").groupBy("series", "t0", "seed").applyInPandas(fit, "series string, t long, model string, f double")


def split_means(r: DataFrame, splits: int, first: int = race.FIRST, refit: int = race.REFIT) -> DataFrame:
    """Forward splits of each fold's training rows: series, t0, i, train_end, test_end, and the mean target (in 1e-4) of both parts.

    With s = t0 // (splits + 1), split i trains on the rows before t0 - (splits - i) s and is tested on the next s. Sums come from
    running sums read at the ends, so no row is joined to the folds it belongs to.
    """
    starts = r.where((F.col("t") >= first) & ((F.col("t") - first) % refit == 0)).select("series", F.col("t").alias("t0"))
    i = F.explode(F.array(*(F.lit(k).cast("long") for k in range(splits))))
    size = F.floor(F.col("t0") / (splits + 1))
    each = starts.withColumn("i", i).withColumns({"train_end": F.col("t0") - (splits - F.col("i")) * size, "test_end": F.col("t0") - (splits - 1 - F.col("i")) * size})
    upto = r.select("series", (F.col("t") + 1).alias("_end"), F.sum("y").over(W.partitionBy("series").orderBy("t").rowsBetween(W.unboundedPreceding, 0)).alias("_sum"))
    for end, name in (("train_end", "_a"), ("test_end", "_b")):
        each = each.join(upto.select("series", F.col("_end").alias(end), F.col("_sum").alias(name)), ["series", end])
    return each.select("series", "t0", "i", "train_end", "test_end", (F.col("_a") / F.col("train_end") * 1e4).alias("train"), ((F.col("_b") - F.col("_a")) / (F.col("test_end") - F.col("train_end")) * 1e4).alias("test"))


def ensemble(forecasts: DataFrame, models: list[str], name: str = "ENS") -> DataFrame:
    """Mean of the models' forecasts, nulls skipped."""
    return forecasts.where(F.col("model").isin(models)).groupBy("series", "t").agg(F.avg("f").alias("f")).select("series", "t", F.lit(name).alias("model"), "f")


def crash_probability(x: DataFrame, columns: list[str], fall: float, classifiers: dict[str, Callable] = CLASSIFIERS, least: int = 5, first: int = race.FIRST, refit: int = race.REFIT) -> DataFrame:
    """Probability of a month under `fall` by each classifier; folds with fewer than `least` such training months give none."""

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        series, t0, model = key
        rows = rows.sort_values("t")
        train, test = rows[rows.t < t0], rows[rows.t >= t0]
        hit = (train.ret_next < fall).to_numpy().astype(float)
        if hit.sum() < least or hit.sum() > len(hit) - least:
            return pd.DataFrame({"series": pd.Series(dtype=str), "t": pd.Series(dtype="int64"), "model": pd.Series(dtype=str), "p": pd.Series(dtype=float), "hit": pd.Series(dtype="int32")})
        p = classifiers[model](train[columns].to_numpy(), hit)(test[columns].to_numpy())
        return pd.DataFrame({"series": series, "t": test.t.to_numpy(), "model": model, "p": np.clip(p, 0, 1), "hit": (test.ret_next < fall).astype(int).to_numpy()})

    folds = fold_rows(x.select("series", "t", "ret_next", *columns), first, refit).where(F.col("t") < F.col("t0") + refit)
    folds = folds.withColumn("model", F.explode(F.array(*map(F.lit, classifiers))))
    return folds.groupBy("series", "t0", "model").applyInPandas(fit, "series string, t long, model string, p double, hit int")


def auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Area under the curve as a rank statistic."""
    r = scored.withColumn("_r", rolling.mean_rank("p", by))
    g = r.groupBy(*by).agg(F.sum(F.when(F.col("hit") == 1, F.col("_r"))).alias("s"), F.sum("hit").alias("pos"), F.count("*").alias("n"))
    return g.select(*by, F.try_divide(F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("n") - F.col("pos"))).alias("auc"))


def importance(x: DataFrame, columns: list[str], first: int = race.FIRST, refit: int = race.REFIT) -> DataFrame:
    """Mean absolute standardised coefficient of each column over the folds."""

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        series, t0 = key
        train = rows[rows.t < t0]
        p = kernels.standardised(kernels.ridge_loo)(train[columns].to_numpy(), np.log(train.y.to_numpy()))
        m, s = train[columns].to_numpy().mean(axis=0), train[columns].to_numpy().std(axis=0)
        base = p(m[None, :])[0]
        return pd.DataFrame({"series": series, "feature": columns, "coef": [p((m + s * (np.arange(len(columns)) == j))[None, :])[0] - base for j in range(len(columns))]})

    got = fold_rows(x.select("series", "t", "y", *columns), first, refit).groupBy("series", "t0").applyInPandas(fit, "series string, feature string, coef double")
    return got.groupBy("series", "feature").agg(F.avg(F.abs("coef")).alias("importance"))

