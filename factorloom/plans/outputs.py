"""Queries of what is handed on: figure frames, bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.operators import bundles, frames, metrics, race
from factorloom.plans import portfolios
from factorloom.plans.registry import query
from factorloom.sources import catalog as c

FRAMES = """mk AS (SELECT series, month, k, ret, rv FROM series_month JOIN cal USING (month)),
crash AS (SELECT k, row_number() OVER (ORDER BY ret, k) AS panel FROM mk WHERE series = 'wml' QUALIFY panel <= 2),
paths AS (SELECT 'crash_paths' AS frame, series, k, ret FROM mk WHERE series IN ('wml', 'mkt') UNION ALL SELECT 'managed_paths', model, k, r FROM strat JOIN cal USING (month) WHERE series = 'wml' AND model IN ('plain', 'RW126') AND r IS NOT NULL),
events AS (SELECT frame, CAST(panel AS VARCHAR) AS panel, series, m.k - c.k AS x, product(1 + ret) OVER (PARTITION BY frame, panel, series ORDER BY m.k) AS value FROM paths m JOIN crash c ON m.k BETWEEN c.k - 12 AND c.k + 12),
past AS (SELECT series, last_day(date) AS month, arg_max(v, date) AS v FROM (SELECT series, date, CASE WHEN count(*) OVER w >= 100 THEN sum(r * r) OVER w END AS v FROM series_day WINDOW w AS (PARTITION BY series ORDER BY date ROWS 125 PRECEDING)) WHERE v IS NOT NULL GROUP BY ALL),
ahead AS (SELECT * FROM (SELECT series, month, stddev_samp(ret) OVER a * sqrt(12) * 100 AS vol, (product(1 + ret) OVER a - 1) * 100 AS ret, avg(ret) OVER a / stddev_samp(ret) OVER a * sqrt(12) AS sharpe, count(*) OVER a AS n FROM series_month WINDOW a AS (PARTITION BY series ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)) JOIN past USING (series, month) WHERE n = 12),
cuts AS (SELECT series, list_sort(list_distinct(quantile_cont(v, [CAST(0 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.4 AS DOUBLE), CAST(0.6 AS DOUBLE), CAST(0.8 AS DOUBLE), CAST(1 AS DOUBLE)]))) AS e FROM ahead GROUP BY 1),
bars AS (SELECT series, q, avg(vol) AS vol, avg(ret) AS ret, avg(sharpe) AS sharpe FROM (SELECT ahead.*, len(list_filter(e[2:-2], lambda x: x < v)) + 1 AS q FROM ahead JOIN cuts USING (series)) WHERE series IN ('wml', 'mkt') GROUP BY ALL)"""


@query("S14b_event_frames", "SELECT frame, panel, series, CAST(x AS DOUBLE) AS x, value FROM events UNION ALL SELECT 'realised_vol', 'all', series, k, sqrt(12 * rv) * 100 FROM mk WHERE series = 'wml' UNION ALL SELECT 'risk_quintiles', panel, series, q, value FROM (UNPIVOT bars ON vol, ret, sharpe INTO NAME panel VALUE value) UNION ALL SELECT 'cumulative', 'all', series, k, sum(ln(1 + ret)) OVER (PARTITION BY series ORDER BY k) FROM mk", FRAMES, floats="x value", digits=5)
def s14b(spark, d):
    """All figure frames in one long table: crash paths and managed paths in event time, volatility by month, bars by risk quintile, cumulative curves in logarithms."""
    daily = c.series_day(spark, d)
    m = race.months(daily)
    mk = m.join(c.months(spark, d), "month")
    crash = frames.crashes(mk.where("series = 'wml'"))
    paths = frames.around(crash, mk.where("series in ('wml', 'mkt')"), ["series"])
    plain = portfolios.strats(spark, d).where("series = 'wml' and model in ('plain', 'RW126')").select(F.col("model").alias("series"), "month", F.col("r").alias("ret")).join(c.months(spark, d), "month")
    managed = frames.around(crash, plain, ["series"])
    bars = frames.next_year_by_risk(daily, m).where("series in ('wml', 'mkt')").unpivot(["series", "q"], ["vol", "ret", "sharpe"], "panel", "value")
    level = F.product(1 + F.col("ret")).over(W.partitionBy("series").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    own, whole = F.col("series"), F.lit("all")
    parts = [
        frames.shown(paths, "crash_paths", F.col("panel"), own, F.col("rel"), F.col("growth")),
        frames.shown(managed, "managed_paths", F.col("panel"), own, F.col("rel"), F.col("growth")),
        frames.shown(mk.where("series = 'wml'"), "realised_vol", whole, own, F.col("k"), F.sqrt(12 * F.col("rv")) * 100),
        frames.shown(bars, "risk_quintiles", F.col("panel"), own, F.col("q"), F.col("value")),
        frames.shown(mk.withColumn("level", level), "cumulative", whole, own, F.col("k"), F.ln("level")),
    ]
    return reduce(DataFrame.unionByName, parts)


def month_text(c: str = "month") -> Column:
    return F.date_format(c, "yyyy-MM")


def bundle(spark, d) -> DataFrame:
    """A document a series: monthly returns, managed returns, forecast and realised volatility, risk quintiles, the table of both strategies, worst months, range."""
    daily = c.series_day(spark, d)
    m = race.months(daily)
    s = portfolios.strats(spark, d).where("model in ('plain', 'RW126')")
    value = lambda name: [month_text().alias("month"), F.col(name).alias("value")]
    forecast = race.variance_features(daily)
    risk = frames.next_year_by_risk(daily, m)
    described = s.groupBy("series", "model").agg(*metrics.describe("r"))
    fields = ["maximum", "minimum", "mean", "std_dev", "kurtosis", "skewness", "sharpe"]
    parts = [
        bundles.listed(m, "series", "returns", ["month"], value("ret")),
        bundles.listed(s.where("model = 'RW126'"), "series", "managed", ["month"], value("r")),
        bundles.listed(forecast.withColumn("v", F.sqrt(12 * F.col("fvar")) * 100), "series", "sigma_hat", ["month"], value("v")),
        bundles.listed(m.withColumn("v", F.sqrt(12 * F.col("rv")) * 100), "series", "realised", ["month"], value("v")),
        bundles.listed(risk, "series", "quintiles", ["q"], [F.col(x).alias(x) for x in ("q", "vol", "ret", "sharpe")]),
        bundles.listed(described, "series", "strategies", ["model"], [F.col(x).alias(x) for x in ("model", *fields)]),
        bundles.listed(m, "series", "worst", ["ret", "month"], value("ret"), 6),
        bundles.listed(m.groupBy("series").agg(F.min("month").alias("month"), F.max("month").alias("last"), F.count("*").alias("n")), "series", "range", ["month"], [month_text().alias("first"), month_text("last").alias("last"), F.col("n").alias("n")]),
    ]
    return bundles.joined(parts, "series")


BUNDLE = FRAMES.replace(" WHERE series IN ('wml', 'mkt') GROUP BY ALL)", " GROUP BY ALL)") + """,
monthly AS (SELECT 'returns' AS key, series, month, ret AS value FROM series_month UNION ALL SELECT 'managed', series, month, r FROM strat WHERE model = 'RW126' UNION ALL SELECT 'sigma_hat', series, month, sqrt(12 * fvar) * 100 FROM fvar UNION ALL SELECT 'realised', series, month, sqrt(12 * rv) * 100 FROM series_month),
low AS (SELECT series, month, ret, row_number() OVER (PARTITION BY series ORDER BY ret, month) - 1 AS rn FROM series_month),
told AS (SELECT series, model, max(r) AS maximum, min(r) AS minimum, avg(r) * 12 AS mean, stddev_samp(r) * sqrt(12) AS std_dev, kurtosis(r) AS kurtosis, skewness(r) AS skewness, sqrt(12) * avg(r) / stddev_samp(r) AS sharpe FROM strat WHERE model IN ('plain', 'RW126') GROUP BY ALL)"""


@query("S13b_panel_bundle", """SELECT series, key, CAST(row_number() OVER (PARTITION BY key, series ORDER BY month) - 1 AS INTEGER) AS pos, strftime(month, '%Y-%m') AS label, 'value' AS field, value FROM monthly
UNION ALL SELECT series, 'worst', CAST(rn AS INTEGER), strftime(month, '%Y-%m'), 'value', ret FROM low WHERE rn < 6
UNION ALL SELECT series, 'range', 0, strftime(min(month), '%Y-%m') || ' ' || strftime(max(month), '%Y-%m'), 'n', count(*) FROM series_month GROUP BY series
UNION ALL SELECT series, 'quintiles', CAST(row_number() OVER (PARTITION BY series, field ORDER BY seat) - 1 AS INTEGER), '', field, value FROM (UNPIVOT (SELECT series, q AS seat, CAST(q AS DOUBLE) AS q, vol, ret, sharpe FROM bars) ON q, vol, ret, sharpe INTO NAME field VALUE value)
UNION ALL SELECT series, 'strategies', CASE WHEN model = 'RW126' THEN 0 ELSE 1 END, model, field, value FROM (UNPIVOT told ON maximum, minimum, mean, std_dev, kurtosis, skewness, sharpe INTO NAME field VALUE value)""", BUNDLE, floats="value", digits=5)
def s13b(spark, d):
    """The documents written as JSON lines and read back, as rows."""
    return bundles.rows(bundles.written(bundle(spark, d), "series"), "series").where("value is not null")
