"""Buy-and-hold portfolio legs in long form, signals and long-short factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.operators import sorts


def calendar_returns(px: DataFrame, days: DataFrame, cap: float | None = None) -> DataFrame:
    """Returns against the previous market day only, null across a gap; returns beyond `cap` are null."""
    w = W.partitionBy("code").orderBy("di")
    r = F.when(F.col("di") - F.lag("di").over(w) == 1, F.try_divide(F.col("adj_close"), F.lag("adj_close").over(w)) - 1)
    out = px.join(days, "date").withColumn("ret", r)
    return out if cap is None else out.withColumn("ret", F.when(F.abs("ret") <= cap, F.col("ret")))


def momentum(px_month: DataFrame, skip: int = 1, back: int = 12) -> DataFrame:
    """Price `skip` months ago over price `back` months ago, less 1, by equi-joins on the month ordinal."""
    now = px_month.select("month", "k", "code", "cap")
    near = px_month.select("code", (F.col("k") + skip).alias("k"), F.col("price").alias("p1"))
    far = px_month.select("code", (F.col("k") + back).alias("k"), F.col("price").alias("p2"))
    return now.join(near, ["code", "k"]).join(far, ["code", "k"]).withColumn("sig", F.try_divide("p1", "p2") - 1).where("sig is not null and cap > 0").drop("p1", "p2")


def eligible(signal: DataFrame, bins: int, times: int = 3) -> DataFrame:
    """Months with at least times * bins names."""
    return signal.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("month"))).where(F.col("_n") >= times * bins).drop("_n")


def extremes(signal: DataFrame, bins: int) -> DataFrame:
    """The top and bottom bucket of each formation month: month, k, code, leg, w0 (the market value)."""
    b = sorts.quantile_buckets(eligible(signal, bins), "sig", bins, ["month"])
    leg = F.when(F.col("bucket") == F.col("_last"), "win").when(F.col("bucket") == 0, "los")
    return b.withColumn("leg", leg).where("leg is not null").select("month", "k", "code", "leg", F.col("cap").alias("w0"))


def held_days(members: DataFrame, returns: DataFrame, days: DataFrame) -> DataFrame:
    """Each member's days of the month after formation, with a null return where it has none.

    The holding month is an equi-join on the month ordinal, not a range join.
    """
    span = days.select("date", "di", (F.col("k") - 1).alias("k"))
    grid = members.select("k", "code", "leg", "w0").join(span, "k")
    return grid.join(returns.select("date", "code", "ret"), ["date", "code"], "left")


def leg_returns(held: DataFrame, missing: str = "renormalize") -> DataFrame:
    """Daily return of each leg: k, leg, date, ret.

    A member's value is its first weight times the product of 1 + return. With `renormalize`, a member
    without a return leaves that day's sums; with `freeze` its value stands still and stays in them.
    """
    own = W.partitionBy("k", "leg", "code").orderBy("di")
    grown = 1 + F.coalesce(F.col("ret"), F.lit(0.0))
    if missing == "renormalize":
        before = F.col("w0") * F.coalesce(F.product(grown).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0))
        valued = held.withColumn("v", F.when(F.col("ret").isNotNull(), before))
        return valued.groupBy("k", "leg", "date", "di").agg(F.try_divide(F.sum(F.col("v") * F.col("ret")), F.sum("v")).alias("ret"))
    if missing != "freeze":
        raise ValueError(f"missing is renormalize or freeze, not {missing}")
    after = F.col("w0") * F.product(grown).over(own.rowsBetween(W.unboundedPreceding, 0))
    total = held.withColumn("v", after).groupBy("k", "leg", "date", "di").agg(F.sum("v").alias("v"), F.sum("w0").alias("v0"))
    w = W.partitionBy("k", "leg").orderBy("di")
    return total.withColumn("ret", F.try_divide("v", F.coalesce(F.lag("v").over(w), F.col("v0"))) - 1).drop("v", "v0")


def compounded(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Product of 1 + value less 1; nulls are skipped."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg((F.product(1 + F.col(value)) - 1).alias(value))


def long_short(legs: DataFrame) -> DataFrame:
    """Monthly top minus bottom of compounded legs: k, win, los, wml."""
    m = compounded(legs, "ret", "k", "leg").groupBy("k").agg(F.max(F.when(F.col("leg") == "win", F.col("ret"))).alias("win"), F.max(F.when(F.col("leg") == "los", F.col("ret"))).alias("los"))
    return m.withColumn("wml", F.col("win") - F.col("los")).where("wml is not null")


def turnover(members: DataFrame) -> DataFrame:
    """Share of a leg's names that were not in it a month before: k, leg, turnover."""
    before = members.select((F.col("k") + 1).alias("k"), "leg", "code", F.lit(1).alias("kept"))
    first = F.col("k") > F.min("k").over(W.partitionBy("leg"))
    j = members.join(before, ["k", "leg", "code"], "left").withColumn("_later", first).where("_later")
    return j.groupBy("k", "leg").agg((1 - F.sum(F.coalesce("kept", F.lit(0))) / F.count(F.lit(1))).alias("turnover"))
