"""Leverage rules, caps and costs over long strategy tables (series, model, t, r, lev)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.operators import rolling


def dynamic(r: DataFrame, gamma: float, low: float, high: float) -> DataFrame:
    """Leverage of past mean over gamma times forecast variance, clipped; column r is the managed return."""
    mu = F.avg("ret_next").over(rolling.expanding_before(["series"], "t"))
    lev = F.least(F.greatest(F.try_divide(mu, gamma * F.col("fvar")), F.lit(float(low))), F.lit(float(high)))
    return r.withColumn("lev", lev).withColumn("r", F.col("lev") * F.col("ret_next"))


def capped(strats: DataFrame, caps: list[float]) -> DataFrame:
    """Returns under each leverage cap: columns cap and x."""
    each = strats.withColumn("cap", F.explode(F.array(*map(F.lit, caps))))
    return each.withColumn("x", F.least("lev", "cap") / F.col("lev") * F.col("r"))


def costs(strats: DataFrame, bps: list[int], borrow: float = 0.0) -> DataFrame:
    """Net returns at each trading cost: twice the change of leverage, and borrowing a year on leverage."""
    each = strats.withColumn("bp", F.explode(F.array(*map(F.lit, bps))))
    w = W.partitionBy("series", "model", "bp").orderBy("t")
    moved = F.abs(F.col("lev") - F.coalesce(F.lag("lev").over(w), F.col("lev")))
    return each.withColumn("net", F.col("r") - F.col("bp") / 10000 * 2 * moved - borrow / 12 * F.col("lev"))


def breakeven(strats: DataFrame, bps: list[int]) -> DataFrame:
    """Cost at which a model's mean over deviation falls to the plain series', between grid points by a straight line."""
    ratio = lambda x: F.try_divide(F.avg(x), F.stddev_samp(x))
    net = costs(strats.where("model != 'plain'"), bps).groupBy("series", "model", "bp").agg(ratio("net").alias("m"))
    plain = strats.where("model = 'plain'").groupBy("series").agg(ratio("r").alias("p"))
    w = W.partitionBy("series", "model").orderBy("bp")
    g = net.join(plain, "series").withColumn("gap", F.col("m") - F.col("p"))
    g = g.withColumn("nxt", F.lead("gap").over(w)).withColumn("nb", F.lead("bp").over(w))
    at = F.when((F.col("gap") >= 0) & (F.col("nxt") < 0), F.col("bp") + (F.col("nb") - F.col("bp")) * F.col("gap") / (F.col("gap") - F.col("nxt")))
    return g.groupBy("series", "model").agg(F.min(at).alias("breakeven"))


def timing(strats: DataFrame, r: DataFrame, fall: float = -0.10, windows: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Leverage of each model at the month before a return under `fall`, and inside windows of months: series, model, span, n, lev, middle.

    A month counts in every span that it belongs to; spans without months give no row.
    """
    falls = r.select("series", "t", (F.col("ret_next") < fall).alias("_falls"))
    spans = [F.when(F.col("_falls"), F.lit("before falls")), *(F.when(F.col("month").between(F.to_date(F.lit(a)), F.to_date(F.lit(b))), F.lit(name)) for name, a, b in windows)]
    each = strats.where("model != 'plain'").join(falls, ["series", "t"]).withColumn("span", F.explode(F.array_compact(F.array(*spans))))
    return each.groupBy("series", "model", "span").agg(F.count("*").alias("n"), F.avg("lev").alias("lev"), F.percentile("lev", 0.5).alias("middle"))


def normalised_dynamic(r: DataFrame, mu: str | None, first: int, refit: int, target: float, low: float = 0.0, high: float = 2.0) -> DataFrame:
    """Leverage of a mean forecast over forecast variance, scaled on each fold's training rows: series, t, free, lev, r.

    `free` is the leverage before it is clipped. `target` is a month's deviation. The scale is target times the mean deviation over the absolute mean return and the mean variance of the rows before the
    fold, so that the average leverage there is about that of plain variance management. Without `mu` the mean of those rows is
    the forecast.
    """
    before = rolling.expanding_before(["series"], "t")
    size = F.greatest(F.abs(F.avg("ret_next").over(before)), F.lit(1e-9))
    scale = target * F.avg(F.sqrt("fvar")).over(before) / size / F.avg("fvar").over(before)
    starts = r.select("series", F.col("t").alias("_t0"), scale.alias("_scale"), F.avg("ret_next").over(before).alias("_mean"))
    own = r.where(F.col("t") >= first).withColumn("_t0", (F.floor((F.col("t") - first) / refit) * refit + first).cast("long"))
    x = own.join(starts, ["series", "_t0"])
    free = F.col("_scale") * F.col(mu or "_mean") / F.col("fvar")
    lev = F.when(free.isNotNull(), F.least(F.greatest(free, F.lit(low)), F.lit(high)))
    return x.select("series", "t", free.alias("free"), lev.alias("lev"), (lev * F.col("ret_next")).alias("r"))
