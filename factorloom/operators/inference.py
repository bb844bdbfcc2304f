"""Tests of forecasts and strategies as sums over lags; distribution functions as vectorised UDFs."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """One value a model or series, so that mapping each is fast enough."""
    own = NormalDist()
    return x.map(lambda v: own.cdf(v), na_action="ignore")


@F.pandas_udf(DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    own = NormalDist()
    return p.map(lambda v: own.inv_cdf(v), na_action="ignore")


def leaderboard(scored: DataFrame) -> DataFrame:
    """Loss, error of annual volatility in per cent, and R2 against the expanding mean, by model."""
    rmse = F.sqrt(F.avg(F.pow((F.sqrt(12 * F.col("f")) - F.sqrt(12 * F.col("y"))) * 100, F.lit(2))))
    e = scored.groupBy("series", "model").agg(F.avg("loss").alias("qlike"), rmse.alias("rmse_vol"), F.sum(F.pow(F.col("y") - F.col("f"), F.lit(2))).alias("sse"), F.count("*").alias("n"))
    base = e.where("model = 'ExpandingMean'").select("series", F.col("sse").alias("_b"))
    return e.join(base, "series").select("series", "model", "qlike", "rmse_vol", ((1 - F.col("sse") / F.col("_b")) * 100).alias("oos_r2"), "n")


def loss_gaps(scored: DataFrame, base: str = "RW126") -> DataFrame:
    """Loss of each model less that of the base in the same month: d, and squared errors' adjusted gap adj."""
    b = scored.where(F.col("model") == base).select("series", "t", F.col("loss").alias("_l"), F.col("f").alias("_f"))
    j = scored.where(F.col("model") != base).join(b, ["series", "t"])
    sq = lambda x: x * x
    adj = sq(F.col("y") - F.col("_f")) - (sq(F.col("y") - F.col("f")) - sq(F.col("_f") - F.col("f")))
    return j.withColumn("d", F.col("loss") - F.col("_l")).withColumn("adj", adj)


def diebold_mariano(gaps: DataFrame, lags: int = 3) -> DataFrame:
    """Mean loss gap over its long-run error: population variance and sample covariances with falling weights."""
    w = W.partitionBy("series", "model").orderBy("t")
    x = gaps
    for k in range(1, lags + 1):
        x = x.withColumn(f"_d{k}", F.lag("d", k).over(w))
    v = F.var_pop("d")
    for k in range(1, lags + 1):
        v = v + 2 * (1 - k / (lags + 1)) * F.covar_samp(F.when(F.col(f"_d{k}").isNotNull(), F.col("d")), f"_d{k}")
    return x.groupBy("series", "model").agg((F.avg("d") / F.sqrt(v / F.count("*"))).alias("stat"))


def clark_west(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("series", "model").agg((F.avg("adj") / (F.stddev_pop("adj") / F.sqrt(F.count("*")))).alias("t"))


def hac_line(df: DataFrame, y: str, x: str, by: list[str], order: str, lags: int = 3) -> DataFrame:
    """Intercept and slope of y on x with HAC errors: a, b, t_a, t_b; all sums of products, no row loop."""
    w = W.partitionBy(*by).orderBy(order)
    whole = W.partitionBy(*by)
    fit = df.withColumn("_b", F.regr_slope(y, x).over(whole)).withColumn("_a", F.regr_intercept(y, x).over(whole))
    u = fit.withColumn("_e", F.col(y) - F.col("_a") - F.col("_b") * F.col(x))
    s00 = s01 = s11 = F.lit(0.0)
    parts = []
    for k in range(lags + 1):
        u = u.withColumn(f"_e{k}", F.lag("_e", k).over(w)).withColumn(f"_x{k}", F.lag(x, k).over(w))
        ee = F.col("_e") * F.col(f"_e{k}")
        parts.append((1 - k / (lags + 1), ee, F.col(f"_x{k}"), 1 if k == 0 else 2))
    for weight, ee, xk, times in parts:
        s00 = s00 + F.sum(weight * times * F.coalesce(ee, F.lit(0.0)))
        s01 = s01 + F.sum(weight * times / 2 * F.coalesce(ee * (F.col(x) + xk), F.lit(0.0)))
        s11 = s11 + F.sum(weight * times * F.coalesce(ee * F.col(x) * xk, F.lit(0.0)))
    g = u.groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(F.col(x) * F.col(x)).alias("sxx"), s00.alias("s00"), s01.alias("s01"), s11.alias("s11"), F.first("_a").alias("a"), F.first("_b").alias("b"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    i00, i01, i11 = F.col("sxx") / det, -F.col("sx") / det, F.col("n") / det
    quad = lambda p, q: p * p * F.col("s00") + 2 * p * q * F.col("s01") + q * q * F.col("s11")
    return g.where(det != 0).select(*by, "a", "b", F.try_divide("a", F.sqrt(quad(i00, i01))).alias("t_a"), F.try_divide("b", F.sqrt(quad(i01, i11))).alias("t_b"))


def sharpe_gap_z(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Test of equal Sharpe ratios of two columns: z."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.avg(a), F.stddev_pop(a)).alias("s1"), F.try_divide(F.avg(b), F.stddev_pop(b)).alias("s0"), F.corr(a, b).alias("rho"))
    s1, s0, rho = F.col("s1"), F.col("s0"), F.col("rho")
    v = (2 - 2 * rho + 0.5 * (s1 * s1 + s0 * s0 - 2 * s1 * s0 * rho * rho)) / F.col("n")
    return g.select(*by, ((s1 - s0) / F.sqrt(v)).alias("z"))


def deflated_sharpe(strats: DataFrame, trials: int | None = None) -> DataFrame:
    """Probability that the best model's ratio beats the expected best of as many noise strategies, by series."""
    each = strats.groupBy("series", "model").agg(F.count("*").alias("n"), F.try_divide(F.avg("r"), F.stddev_pop("r")).alias("sr"), F.skewness("r").alias("g3"), (F.kurtosis("r") + 3).alias("g4"))
    g = each.groupBy("series").agg(F.max_by(F.struct("model", "n", "sr", "g3", "g4"), "sr").alias("x"), F.var_pop("sr").alias("v"), F.count("*").alias("m"))
    n = F.lit(float(trials)) if trials else F.col("m").cast("double")
    euler = 0.5772156649015329  # fixed value: Euler's constant
    noise = F.sqrt("v") * ((1 - euler) * normal_ppf(1 - 1 / n) + euler * normal_ppf(1 - 1 / (n * F.exp(F.lit(1.0)))))
    sr = F.col("x.sr")
    stat = (sr - F.col("sr0")) * F.sqrt(F.col("x.n") - 1) / F.sqrt(1 - F.col("x.g3") * sr + (F.col("x.g4") - 1) / 4 * sr * sr)
    return g.withColumn("sr0", noise).select("series", F.col("x.model").alias("model"), sr.alias("sr"), "sr0", normal_cdf(stat).alias("dsr"))


def hill(df: DataFrame, by: list[str], k: int = 20) -> DataFrame:
    """Tail index of losses from the k largest over the next one."""
    rn = F.row_number().over(W.partitionBy(*by).orderBy("r"))
    x = df.where("r < 0").withColumn("_rn", rn).where(F.col("_rn") <= k + 1)
    g = x.groupBy(*by).agg(F.avg(F.when(F.col("_rn") <= k, F.ln(-F.col("r")))).alias("m"), F.max(F.when(F.col("_rn") == k + 1, F.ln(-F.col("r")))).alias("u"))
    return g.where("u is not null").select(*by, F.try_divide(F.lit(1.0), F.col("m") - F.col("u")).alias("alpha"))


def verdict(delta: str, p: str) -> Column:
    """Three-way reading fixed beforehand: supported, mixed, rejected."""
    return F.when((F.col(delta) > 0) & (F.col(p) < 0.1), "supported").when(F.col(delta) > 0, "mixed").otherwise("rejected")
