"""Calendars: dense ordinals, month ends, month arithmetic, delisting events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Calendar days of a block in which dates are numbered.
SPAN = 256


def ordinals(df: DataFrame, key: str, name: str) -> DataFrame:
    """Dense ordinal, from 1, of each distinct date: numbered inside blocks of the calendar, after the dates of the blocks before."""
    each = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_part", F.floor(F.unix_date(key) / SPAN))
    sizes = each.groupBy("_part").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("_part", "n"))).alias("s"))  # one entry a block of the calendar
    before = F.transform("s", lambda x: F.struct(x["_part"].alias("_part"), F.aggregate(F.filter("s", lambda y: y["_part"] < x["_part"]), F.lit(0).cast("long"), lambda total, y: total + y["n"]).alias("_before")))
    starts = sizes.select(F.inline(before))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(key))
    return each.withColumn("_in", inside).join(F.broadcast(starts), "_part").select(key, (F.col("_before") + F.col("_in")).cast("long").alias(name))


def with_ordinal(df: DataFrame, key: str, name: str) -> DataFrame:
    """Join the dense ordinal of a calendar column on."""
    return df.join(ordinals(df, key, name), key)


def month_end_days(days: DataFrame) -> DataFrame:
    """Last trading day of each calendar month: month, last_day."""
    return days.groupBy(F.last_day("date").alias("month")).agg(F.max("date").alias("last_trade"))


def last_values(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Last non-null value in each calendar month."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.last_day("date").alias("month")).agg(F.max_by(value, "date").alias(value))


def shift_month(month: str, n: int) -> Column:
    return F.last_day(F.add_months(month, n))


def annual_percent_to_month(c: Column) -> Column:
    return F.pow(1 + c / 100, F.lit(1 / 12)) - 1


def delisting_events(px: DataFrame, rows: int = 30) -> DataFrame:
    """Codes whose last valid day lies before the `rows`-th day from the end; the event is on the next day."""
    days = ordinals(px, "date", "di")
    last = px.where("adj_close is not null").join(days, "date").groupBy("code").agg(F.max("di").alias("last_di"))
    total = days.agg(F.max("di").alias("n"))
    return last.join(F.broadcast(total)).where(F.col("last_di") < F.col("n") - rows).select("code", (F.col("last_di") + 1).alias("di"))


def delisted_by_date(px: DataFrame, days: int = 30) -> DataFrame:
    """The same by calendar days: codes last seen more than `days` days before the end."""
    last = px.where("adj_close is not null").groupBy("code").agg(F.max("date").alias("last_seen"))
    return last.join(F.broadcast(px.agg(F.max("date").alias("end")))).where(F.col("last_seen") < F.date_sub("end", days)).drop("end")
