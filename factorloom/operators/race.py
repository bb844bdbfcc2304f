"""The forecast race: features and targets by month, folds, baseline forecasts, managed strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.operators import metrics, rolling, scans

FIRST, REFIT = 36, 6
LAMBDAS = (0.7, 0.8, 0.9, 0.94)
TARGET = 0.12


def months(series_day: DataFrame, *by: str) -> DataFrame:
    """Monthly return, realised variance and downside semivariance of each series."""
    by = by or ("series",)
    r = F.col("r")
    return series_day.groupBy(*by, F.last_day("date").alias("month")).agg((F.product(1 + r) - 1).alias("ret"), F.sum(r * r).alias("rv"), F.sum(F.when(r < 0, r * r).otherwise(0.0)).alias("down"))


def variance_features(series_day: DataFrame, w: int = 126, least: int = 126) -> DataFrame:
    """Month-end value of 21 times the mean square of the last w returns: series, month, fvar."""
    over = rolling.trailing(["series"], "date", w)
    v = series_day.withColumn("fvar", rolling.variance_forecast("r", over, least)).where("fvar is not null")
    return v.groupBy("series", F.last_day("date").alias("month")).agg(F.max_by("fvar", "date").alias("fvar"))


def race(series_day: DataFrame, w: int = 126) -> DataFrame:
    """Rows (series, month, t): next month's variance y and return, and what is known at the month's end."""
    m = months(series_day)
    o = W.partitionBy("series").orderBy("month")
    m = m.withColumn("y", F.lead("rv").over(o)).withColumn("ret_next", F.lead("ret").over(o))
    joined = m.join(variance_features(series_day, w, w), ["series", "month"]).where("y is not null")
    return joined.withColumn("t", (F.row_number().over(o) - 1).cast("long")).select("series", "month", "t", "y", "rv", "down", "fvar", "ret", "ret_next")


def folds(r: DataFrame, first: int = FIRST, refit: int = REFIT) -> DataFrame:
    """Row t of a test fold and the fold's start t0; training rows are those before t0."""
    return r.where(F.col("t") >= first).select("series", "t", (F.floor((F.col("t") - first) / refit) * refit + first).cast("long").alias("t0"))


def ewmas(r: DataFrame) -> DataFrame:
    """The recursion for every lambda: series, t, lam, f."""
    each = r.select("series", "t", "y", F.explode(F.array(*map(F.lit, LAMBDAS))).alias("lam"))
    return scans.smoothed(each, ["series", "lam"], "t", "y", "lam", "f").select("series", "t", "lam", "f")


def baselines(r: DataFrame, first: int = FIRST, refit: int = REFIT) -> DataFrame:
    """Forecasts of the expanding mean, the 126-day variance and the tuned recursion: series, t, model, f.

    A fold's training mean is a running sum read at the fold's start, so no row is joined to its past.
    """
    o = W.partitionBy("series").orderBy("t")
    of = folds(r, first, refit)
    before = r.select("series", F.col("t").alias("t0"), F.avg("y").over(o.rowsBetween(W.unboundedPreceding, -1)).alias("f"))
    mean = of.join(before, ["series", "t0"]).select("series", "t", F.lit("ExpandingMean").alias("model"), "f")
    walk = r.where(F.col("t") >= first).select("series", "t", F.lit("RW126").alias("model"), F.col("fvar").alias("f"))
    e = ewmas(r)
    lossy = e.join(r.select("series", "t", "y"), ["series", "t"]).withColumn("loss", F.when(F.col("t") >= 12, metrics.qlike("y", "f")))
    upto = F.avg("loss").over(W.partitionBy("series", "lam").orderBy("t").rowsBetween(W.unboundedPreceding, -1))
    best = lossy.select("series", F.col("t").alias("t0"), "lam", upto.alias("loss")).groupBy("series", "t0").agg(F.min_by("lam", F.struct("loss", "lam")).alias("lam"))
    tuned = of.join(best, ["series", "t0"]).join(e, ["series", "t", "lam"]).select("series", "t", F.lit("EWMA").alias("model"), "f")
    return mean.unionByName(walk).unionByName(tuned)


def leverage(forecast: str = "f", target: float = TARGET):
    return F.lit(target / 12**0.5) / F.sqrt(forecast)


def scored(r: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Forecasts with actual variance, loss, next return and leverage."""
    j = forecasts.join(r.select("series", "t", "month", "y", "ret_next"), ["series", "t"])
    return j.withColumn("loss", metrics.qlike("y", "f")).withColumn("lev", leverage())


def strategies(r: DataFrame, forecasts: DataFrame, first: int = FIRST) -> DataFrame:
    """Managed returns lev * next return of each model, and the plain series: series, model, t, month, r, lev."""
    s = scored(r, forecasts)
    managed = s.select("series", "model", "t", "month", (F.col("lev") * F.col("ret_next")).alias("r"), "lev")
    plain = r.where(F.col("t") >= first).select("series", F.lit("plain").alias("model"), "t", "month", F.col("ret_next").alias("r"), F.lit(1.0).alias("lev"))
    return managed.unionByName(plain)
