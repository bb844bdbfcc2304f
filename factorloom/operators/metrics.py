"""Performance and risk statistics as aggregate expressions of a return column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sharpe(r: str | Column, population: bool = False, periods: int = 12) -> Column:
    return F.sqrt(F.lit(periods)) * F.try_divide(F.avg(r), (F.stddev_pop if population else F.stddev_samp)(r))


def mean_t(r: str | Column) -> Column:
    return F.try_divide(F.avg(r), F.stddev_samp(r) / F.sqrt(F.count(r)))


def skew_corrected(r: str | Column) -> Column:
    """Bias-corrected skewness from the population one."""
    n = F.count(r).cast("double")
    return F.when(n > 2, F.skewness(r) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_corrected(r: str | Column) -> Column:
    """Bias-corrected excess kurtosis from the population one."""
    n = F.count(r).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(r) + 6))


def describe(r: str | Column) -> list[Column]:
    return [F.max(r).alias("maximum"), F.min(r).alias("minimum"), (F.avg(r) * 12).alias("mean"), (F.stddev_samp(r) * F.sqrt(F.lit(12.0))).alias("std_dev"), kurt_corrected(r).alias("kurtosis"), skew_corrected(r).alias("skewness"), sharpe(r).alias("sharpe")]


def expected_shortfall(df: DataFrame, r: str, by: list[str], q: float = 0.05, name: str = "es") -> DataFrame:
    """Mean of the max(1, floor(q n)) smallest values, in per cent."""
    n = F.count(r).over(W.partitionBy(*by))
    rn = F.row_number().over(W.partitionBy(*by).orderBy(F.col(r)))
    worst = df.where(F.col(r).isNotNull()).select(*by, r, n.alias("_n"), rn.alias("_rn")).where(F.col("_rn") <= F.greatest(F.lit(1), F.floor(q * F.col("_n"))))
    return worst.groupBy(*by).agg((F.avg(r) * 100).alias(name))


def mv_certainty(r: str | Column, gamma: float | Column) -> Column:
    """Mean-variance certainty equivalent, annual per cent."""
    return (F.avg(r) - gamma / 2 * F.var_pop(r)) * 1200


def crra_certainty(r: str, gamma: float) -> Column:
    """CRRA certainty equivalent a year; null if a month loses all."""
    ok = F.min(1 + F.col(r)) > 0
    base = F.exp(F.avg(F.ln(1 + F.col(r)))) if gamma == 1 else F.pow(F.avg(F.pow(1 + F.col(r), F.lit(1 - gamma))), F.lit(1 / (1 - gamma)))
    return F.when(ok, F.pow(base, F.lit(12)) - 1)


def qlike(actual: str, forecast: str) -> Column:
    x = F.try_divide(actual, forecast)
    return x - F.ln(x) - 1
