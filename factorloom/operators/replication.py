"""Replication gate of a long-short factor: do its plain and managed returns behave as a published table says?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.operators import calendar, metrics, race


def managed(monthly: DataFrame, daily: DataFrame, target: float = race.TARGET, w: int = 126) -> DataFrame:
    """Monthly returns r of each series and star, scaled by the variance known at the end of the month before: series, month, r, star.

    star is null where fewer than w days precede the month.
    """
    known = race.variance_features(daily, w, w).select("series", calendar.shift_month("month", 1).alias("month"), "fvar")
    return monthly.withColumn("month", F.last_day("month")).join(known, ["series", "month"], "left").withColumn("star", race.leverage("fvar", target) * F.col("r"))


def gate(table: DataFrame, samples: dict[str, Column], sharpe: tuple[float, float] = (0.35, 0.65), skew: float = -1.0, gain: float = 1.3, worst: float = -0.5) -> DataFrame:
    """One row a series and sample: moments of plain and managed returns and whether they pass.

    A sample passes if its plain Sharpe ratio lies inside `sharpe`, its skewness is below `skew`, its worst month below `worst`,
    and the managed Sharpe ratio of the same months exceeds `gain` times the plain one. Without managed months it does not pass.
    """
    each = table.where("r is not null").withColumn("sample", F.explode(F.array_compact(F.array(*(F.when(of, F.lit(name)) for name, of in samples.items())))))
    by = ["series", "sample"]
    scale = W.partitionBy(*by)
    order = F.row_number().over(scale.orderBy("r", "month"))
    gap = F.try_divide("star", F.stddev_samp("star").over(scale)) - F.try_divide("r", F.stddev_samp("r").over(scale))
    stats = lambda r, name: [metrics.sharpe(r, population=True).alias(f"{name}sharpe"), F.skewness(r).alias(f"{name}skew"), F.kurtosis(r).alias(f"{name}kurtosis"), (F.min(r) * 100).alias(f"{name}worst")]
    out = each.withColumns({"_rank": order, "_gap": gap}).groupBy(*by).agg(
        F.count("*").alias("n"), (F.avg("r") * 1200).alias("mean"), *stats("r", ""), (F.max(F.when(F.col("_rank") == 2, F.col("r"))) * 100).alias("second_worst"),
        *stats("star", "managed_"), metrics.sharpe("_gap", population=True).alias("information_ratio"),
    )
    passes = (F.col("sharpe") > sharpe[0]) & (F.col("sharpe") < sharpe[1]) & (F.col("skew") < skew) & (F.col("managed_sharpe") > gain * F.col("sharpe")) & (F.col("worst") < worst * 100)
    return out.withColumn("passes", F.coalesce(passes, F.lit(False)))
