"""The tables behind figures, in one long form: frame, panel, series, x, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.operators import rolling, sorts

COLUMNS = ["frame", "panel", "series", "x", "value"]
#: Months on either side of a crash.
REACH = 12


def shown(df: DataFrame, frame: str, panel: Column, series: Column, x: Column, value: Column) -> DataFrame:
    return df.select(F.lit(frame).alias("frame"), panel.cast("string").alias("panel"), series.alias("series"), x.cast("double").alias("x"), value.cast("double").alias("value")).where("value is not null")


def crashes(months: DataFrame, n: int = 2) -> DataFrame:
    """The n months of the worst returns: k and panel, 1 for the worst. `months` has k and ret."""
    worst = months.orderBy("ret", "k").limit(n).agg(F.array_sort(F.collect_list(F.struct("ret", "k"))).alias("w"))
    return worst.select(F.posexplode("w").alias("at", "c")).select((F.col("at") + 1).alias("panel"), F.col("c.k").alias("k"))


def around(events: DataFrame, months: DataFrame, by: list[str], reach: int = REACH) -> DataFrame:
    """Growth of 1 in event time: rel runs over the months before and after each event, by an equi-join on the month's ordinal."""
    span = events.withColumn("rel", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).select("panel", "rel", (F.col("k") + F.col("rel")).alias("k"))
    w = W.partitionBy("panel", *by).orderBy("rel").rowsBetween(W.unboundedPreceding, 0)
    return months.where("ret is not null").join(F.broadcast(span), "k").withColumn("growth", F.product(1 + F.col("ret")).over(w))


def next_year_by_risk(daily: DataFrame, months: DataFrame, bins: int = 5) -> DataFrame:
    """Mean volatility, return (per cent) and Sharpe ratio of the next 12 months by quantile of the last 126 days' squared returns."""
    r = F.col("r")
    risk = daily.withColumn("v", rolling.full(F.sum(r * r), "r", rolling.trailing(["series"], "date", 126), 100)).where("v is not null")
    risk = risk.groupBy("series", F.last_day("date").alias("month")).agg(F.max_by("v", "date").alias("v"))
    ahead = rolling.forward(["series"], "month")
    sd, mean = rolling.full(F.stddev_samp("ret"), "ret", ahead, 12), rolling.full(F.avg("ret"), "ret", ahead, 12)
    grown = (rolling.full(F.product(1 + F.col("ret")), "ret", ahead, 12) - 1) * 100
    j = months.select("series", "month", (sd * F.sqrt(F.lit(12.0)) * 100).alias("vol"), grown.alias("ret"), (F.try_divide(mean, sd) * F.sqrt(F.lit(12.0))).alias("sharpe")).where("sharpe is not null").join(risk, ["series", "month"])
    each = sorts.quantile_buckets(j, "v", bins, ["series"]).groupBy("series", "bucket").agg(*(F.avg(c).alias(c) for c in ("vol", "ret", "sharpe")))
    return each.withColumn("q", F.col("bucket") + 1)
