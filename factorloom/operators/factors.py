"""Market, size, value and size-momentum factors from long panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.operators import legs, sorts


def market(returns: DataFrame, days: DataFrame) -> DataFrame:
    """Mean return weighted by the market value of the day before (the market's day, not the code's)."""
    w = W.partitionBy("code").orderBy("di")
    x = returns.join(days.select("date", "di"), "date").withColumn("pc", F.when(F.col("di") - F.lag("di").over(w) == 1, F.lag("cap").over(w)))
    x = x.where("pc is not null and ret is not null")
    return x.groupBy("date").agg(F.try_divide(F.sum(F.col("pc") * F.col("ret")), F.sum("pc")).alias("mkt"))


def with_delisting(returns: DataFrame, days: DataFrame, value: float, rows: int = 30) -> DataFrame:
    """Returns with `value` on the day after a code's last, if that lies before the `rows`-th day from the end."""
    last = returns.join(days.select("date", "di"), "date").groupBy("code").agg((F.max("di") + 1).alias("di"))
    end = days.agg(F.max("di").alias("end"))
    events = last.join(F.broadcast(end)).where(F.col("di") - 1 < F.col("end") - rows).join(days.select("date", "di"), "di")
    return returns.select("date", "code", "ret").unionByName(events.select("date", "code", F.lit(value).alias("ret")))


def size_value(px_month: DataFrame, returns: DataFrame, days: DataFrame) -> DataFrame:
    """Daily SMB and HML of groups formed each June and held from July to June; a missing group returns 0."""
    june = px_month.where("month(month) = 6").select(F.year("month").alias("year"), "code", F.col("cap").alias("w0"), (1 / F.col("pbr")).alias("bm"))
    edges = june.groupBy("year").agg(F.percentile("w0", 0.5).alias("med"), F.percentile("bm", 0.3).alias("p30"), F.percentile("bm", 0.7).alias("p70"))
    group = june.join(edges, "year").select(F.col("year").alias("k"), "code", "w0", sorts.corner(F.col("w0"), F.col("med"), F.col("bm"), F.col("p30"), F.col("p70")).alias("leg"))
    held_year = F.when(F.month("date") > 6, F.year("date")).otherwise(F.year("date") - 1)
    held = group.join(days.select("date", "di", held_year.alias("k")), "k").join(returns.select("date", "code", "ret"), ["date", "code"], "left")
    daily = legs.leg_returns(held)
    at = lambda g: F.coalesce(F.max(F.when(F.col("leg") == g, F.col("ret"))), F.lit(0.0))
    smb = sum((at(g) for g in ("SM", "SH")), at("SL")) / 3 - sum((at(g) for g in ("BM", "BH")), at("BL")) / 3
    hml = (at("SH") + at("BH")) / 2 - (at("SL") + at("BL")) / 2
    return daily.groupBy("date").agg(smb.alias("smb"), hml.alias("hml"))


def size_momentum(signal: DataFrame, returns: DataFrame, days: DataFrame, least: int) -> DataFrame:
    """Monthly mean of the two winner corners less that of the loser corners of a 2x3 sort, values frozen on missing days.

    A month counts if all four corners have names, `least` in all.
    """
    edges = signal.groupBy("k").agg(F.percentile("cap", 0.5).alias("med"), F.percentile("sig", 0.3).alias("p30"), F.percentile("sig", 0.7).alias("p70"))
    group = signal.join(edges, "k").select("k", "code", F.col("cap").alias("w0"), sorts.corner(F.col("cap"), F.col("med"), F.col("sig"), F.col("p30"), F.col("p70")).alias("leg"))
    corners = group.where(F.col("leg").isin("SL", "SH", "BL", "BH"))
    ok = corners.groupBy("k").agg(F.count_distinct("leg").alias("legs"), F.count("*").alias("n")).where((F.col("legs") == 4) & (F.col("n") >= least)).select("k")
    daily = legs.leg_returns(legs.held_days(corners.join(ok, "k", "left_semi"), returns, days), missing="freeze")
    m = legs.compounded(daily, "ret", "k", "leg")
    at = lambda g: F.max(F.when(F.col("leg") == g, F.col("ret")))
    return m.groupBy("k").agg(((at("SH") + at("BH")) / 2 - (at("SL") + at("BL")) / 2).alias("wml"))


def equal_weighted(members: DataFrame, px_month: DataFrame) -> DataFrame:
    """Equal-weighted top minus bottom of the next month's returns: k, wml."""
    later = px_month.select((F.col("k") - 1).alias("k"), "code", "ret")
    at = lambda g: F.avg(F.when(F.col("leg") == g, F.col("ret")))
    return members.join(later, ["k", "code"]).groupBy("k").agg((at("win") - at("los")).alias("wml")).where("wml is not null")
