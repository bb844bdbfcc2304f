"""Panel-shaped views over the driver's tables: prices, returns, factors, risk-free rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators import calendar
from factorloom.sources.shared import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades of a brand: date, code, ext (size), r (a bounded return), qty, flag, supp."""
    li = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), "l_partkey", F.col("l_extendedprice").alias("ext"), (F.col("l_discount") - F.col("l_tax")).alias("r"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("supp")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("code"))
    return li.join(part, li.l_partkey == part.p_partkey).drop("l_partkey", "p_partkey")


def weighted(value: str, weight: str, where=None):
    """Weighted mean as two conditional sums; null where no weight is left."""
    w = F.col(weight) if where is None else F.when(where, F.col(weight))
    return F.try_divide(F.sum(w * F.col(value)), F.sum(w))


@saved("lineitem", "part")
def line_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the lines by date, code and flag: ext, er (ext times r), qty, n. The views below come from it, not from the lines."""
    each = lines(spark, sf_dir).groupBy("date", "code", "flag")
    return each.agg(F.sum("ext").alias("ext"), F.sum(F.col("ext") * F.col("r")).alias("er"), F.sum("qty").alias("qty"), F.count("*").alias("n"))


def px_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_day(spark, sf_dir).groupBy("date", "code").agg((F.sum("ext") / F.sum("n")).alias("adj_close"), F.sum("ext").alias("market_cap"))


@saved("lineitem", "part")
def ret_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_day(spark, sf_dir).groupBy("date", "code").agg(F.try_divide(F.sum("er"), F.sum("ext")).alias("ret"), F.sum("ext").alias("cap"))


@saved("lineitem", "part")
def px_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = line_day(spark, sf_dir).groupBy(F.last_day("date").alias("month"), "code")
    m = m.agg((F.sum("ext") / F.sum("n")).alias("price"), F.sum("ext").alias("cap"), F.try_divide(F.sum("er"), F.sum("ext")).alias("ret"), (F.sum("qty") / F.sum("n")).alias("pbr"))
    return m.join(months(spark, sf_dir), "month")


@saved("lineitem", "part")
def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's calendar: date, its ordinal di and its month's ordinal k."""
    d = line_day(spark, sf_dir).select("date")
    month = calendar.ordinals(d.select(F.last_day("date").alias("month")), "month", "k")
    return calendar.ordinals(d, "date", "di").withColumn("month", F.last_day("date")).join(F.broadcast(month), "month").select("date", "di", "k")


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar months with a trading day: month, k."""
    return days(spark, sf_dir).select(F.last_day("date").alias("month"), "k").distinct()


@saved("lineitem", "part")
def factor_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily factor: winners minus losers, and the market."""
    side = lambda flag: F.try_divide(F.sum(F.when(F.col("flag") == flag, F.col("er"))), F.sum(F.when(F.col("flag") == flag, F.col("ext"))))
    f = line_day(spark, sf_dir).groupBy("date").agg(side("A").alias("win"), side("R").alias("los"), F.try_divide(F.sum("er"), F.sum("ext")).alias("mkt"))
    return f.withColumn("wml", F.col("win") - F.col("los"))


def series_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily factor's parts as a long table (series, date, r): series is the parallel key."""
    return factor_day(spark, sf_dir).unpivot("date", ["win", "los", "mkt", "wml"], "series", "r").where("r is not null")


@saved("orders")
def rf_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.last_day(F.to_date("o_orderdate")).alias("month")).agg((F.avg("o_totalprice") / 1e8).alias("rf"))


def market_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by region of the supplier: market is the parallel key."""
    t = lambda n: table(spark, sf_dir, n)
    places = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("market"))
    return lines(spark, sf_dir).join(places, F.col("supp") == F.col("s_suppkey")).drop("s_suppkey")


@saved("lineitem", "part", "supplier", "nation", "region")
def market_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = market_lines(spark, sf_dir).groupBy("market", "date").agg(weighted("r", "ext", F.col("flag") == "A").alias("win"), weighted("r", "ext", F.col("flag") == "R").alias("los"))
    return f.select("market", "date", (F.col("win") - F.col("los")).alias("r")).where("r is not null")
