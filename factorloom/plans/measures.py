"""Queries of aggregates, windows, sorts and ordering."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.operators import calendar, legs, metrics, quantiles, race, reshape, rolling, scans, sorts
from factorloom.plans.panels import SIGNAL
from factorloom.plans.registry import query
from factorloom.sources import catalog as c
from factorloom.sources.shared import saved
from factorloom.streaming import daily_risk


def by_month():
    return W.partitionBy("series").orderBy("month")


def months(spark, d):
    return race.months(c.series_day(spark, d))


@saved("lineitem", "part")
def race_of(spark, d):
    """The race's rows of every series: next month's variance, and what is known at the month's end."""
    return race.race(c.series_day(spark, d))


@query("G01_realised_variance", "SELECT series, month, rv FROM series_month", floats="rv", digits=8, dates="month")
def g01(spark, d):
    return months(spark, d).select("series", "month", "rv")


@query("G02_semivariance", "SELECT series, month, down, CASE WHEN rv > 0 THEN least(greatest(down / rv, 0), 1) END AS ratio FROM series_month", floats="down ratio", dates="month")
def g02(spark, d):
    r = F.try_divide("down", "rv")
    return months(spark, d).select("series", "month", "down", F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0)).alias("ratio"))


@query("G03_compounding", "SELECT series, month, ret FROM series_month", floats="ret", dates="month")
def g03(spark, d):
    return legs.compounded(c.series_day(spark, d).withColumn("month", F.last_day("date")), "r", "series", "month").withColumnRenamed("r", "ret")


@query("G04_weighted_mean", "SELECT date, sum(cap * ret) / sum(cap) AS ret FROM ret_day GROUP BY 1", floats="ret", dates="date")
def g04(spark, d):
    return c.ret_day(spark, d).groupBy("date").agg(c.weighted("ret", "cap").alias("ret"))


@query("G05_describe", "SELECT series, max(ret) AS maximum, min(ret) AS minimum, avg(ret) * 12 AS mean, stddev_samp(ret) * sqrt(12) AS std_dev, kurtosis(ret) AS kurtosis, skewness(ret) AS skewness, sqrt(12) * avg(ret) / stddev_samp(ret) AS sharpe FROM series_month GROUP BY 1", floats="maximum minimum mean std_dev kurtosis skewness sharpe")
def g05(spark, d):
    return months(spark, d).groupBy("series").agg(*metrics.describe("ret"))


@query("G06_sharpe", "SELECT series, sqrt(12) * avg(ret) / stddev_samp(ret) AS sample, sqrt(12) * avg(ret) / stddev_pop(ret) AS population FROM series_month GROUP BY 1", floats="sample population")
def g06(spark, d):
    return months(spark, d).groupBy("series").agg(metrics.sharpe("ret").alias("sample"), metrics.sharpe("ret", population=True).alias("population"))


@query("G07_mean_t", "SELECT series, avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) AS t FROM series_month GROUP BY 1", floats="t")
def g07(spark, d):
    return months(spark, d).groupBy("series").agg(metrics.mean_t("ret").alias("t"))


@query("G08_expected_shortfall", "SELECT series, avg(ret) * 100 AS es FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ret) AS rn, count(*) OVER (PARTITION BY series) AS n FROM series_month) WHERE rn <= greatest(1, floor(CAST(0.05 AS DOUBLE) * n)) GROUP BY 1", floats="es")
def g08(spark, d):
    return metrics.expected_shortfall(months(spark, d), "ret", ["series"])


LEVEL = "lv AS (SELECT series, date, product(1 + r) OVER (PARTITION BY series ORDER BY date) AS level FROM series_day)"


def levels(spark, d):
    return c.series_day(spark, d).withColumn("level", rolling.index_level("r", ["series"], "date"))


@query("G09_max_drawdown", "SELECT series, min(dd) AS mdd FROM (SELECT series, level / max(level) OVER (PARTITION BY series ORDER BY date) - 1 AS dd FROM lv) GROUP BY 1", LEVEL, floats="mdd")
def g09(spark, d):
    return levels(spark, d).withColumn("dd", rolling.drawdown("level", ["series"], "date")).groupBy("series").agg(F.min("dd").alias("mdd"))


QUINT = "edges AS (SELECT series, list_distinct(quantile_cont(fvar, [CAST(0 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.4 AS DOUBLE), CAST(0.6 AS DOUBLE), CAST(0.8 AS DOUBLE), CAST(1 AS DOUBLE)])) AS e FROM race GROUP BY 1), qd AS (SELECT race.*, len(list_filter(list_sort(e)[2:-2], lambda x: x < fvar)) AS bucket FROM race JOIN edges USING (series))"


def quint(spark, d):
    return sorts.quantile_buckets(race_of(spark, d), "fvar", 5, ["series"])


@query("G10_risk_quintiles", "SELECT series, bucket, avg(sqrt(y)) AS vol, avg(ret_next) AS ret, sqrt(12) * avg(ret_next) / stddev_samp(ret_next) AS sharpe FROM qd GROUP BY ALL", QUINT, floats="vol ret sharpe")
def g10(spark, d):
    return quint(spark, d).groupBy("series", "bucket").agg(F.avg(F.sqrt("y")).alias("vol"), F.avg("ret_next").alias("ret"), metrics.sharpe("ret_next").alias("sharpe"))


@query("G11_quantiles", "SELECT code, quantile_cont(ret, CAST(0.3 AS DOUBLE)) AS p30, median(ret) AS p50, quantile_cont(ret, CAST(0.95 AS DOUBLE)) AS p95 FROM ret_day GROUP BY 1", floats="p30 p50 p95")
def g11(spark, d):
    return c.ret_day(spark, d).groupBy("code").agg(F.percentile("ret", 0.3).alias("p30"), F.percentile("ret", 0.5).alias("p50"), F.percentile("ret", 0.95).alias("p95"))


@query("G12_counts_by_year", "SELECT year(date) AS year, count(*) AS n, count(DISTINCT code) AS codes FROM ret_day WHERE abs(ret) > 0.05 GROUP BY 1 ORDER BY n DESC, year LIMIT 4")
def g12(spark, d):
    g = c.ret_day(spark, d).where("abs(ret) > 0.05").groupBy(F.year("date").cast("long").alias("year")).agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes"))
    return g.orderBy(F.desc("n"), "year").limit(4)


@query("G13_correlation", "SELECT corr(win, los) AS r, covar_samp(win, los) * 1e4 AS cov FROM factor_day WHERE win IS NOT NULL AND los IS NOT NULL", floats="r cov")
def g13(spark, d):
    return c.factor_day(spark, d).where("win is not null and los is not null").agg(F.corr("win", "los").alias("r"), (F.covar_samp("win", "los") * 1e4).alias("cov"))


RANKS = "rk AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY cap) + (count(*) OVER (PARTITION BY k, cap) - 1) / 2.0 AS a, rank() OVER (PARTITION BY k ORDER BY ret) + (count(*) OVER (PARTITION BY k, ret) - 1) / 2.0 AS b FROM px_month)"


@query("G14_spearman", "SELECT k, corr(a, b) AS rho FROM rk GROUP BY 1", RANKS, floats="rho")
def g14(spark, d):
    p = c.px_month(spark, d).select("k", rolling.mean_rank("cap", ["k"]).alias("a"), rolling.mean_rank("ret", ["k"]).alias("b"))
    return p.groupBy("k").agg(F.corr("a", "b").alias("rho"))


@query("G15_ols_line", "SELECT series, regr_slope(ret_next, fvar) AS slope, regr_intercept(ret_next, fvar) AS intercept, regr_r2(ret_next, fvar) AS r2 FROM race GROUP BY 1", floats="slope intercept r2")
def g15(spark, d):
    g = race_of(spark, d).groupBy("series")
    return g.agg(F.regr_slope("ret_next", "fvar").alias("slope"), F.regr_intercept("ret_next", "fvar").alias("intercept"), F.regr_r2("ret_next", "fvar").alias("r2"))


@query("G16_named_aggregates", "SELECT code, avg(ret) AS mean, min(ret) AS least, max(ret) AS most FROM ret_day GROUP BY 1", floats="mean least most")
def g16(spark, d):
    return c.ret_day(spark, d).groupBy("code").agg(F.avg("ret").alias("mean"), F.min("ret").alias("least"), F.max("ret").alias("most"))


@query("G17_information_ratio", "SELECT sqrt(12) * avg(w / sw - m / sm) / stddev_samp(w / sw - m / sm) AS ir FROM (SELECT a.ret AS w, b.ret AS m FROM series_month a JOIN series_month b USING (month) WHERE a.series = 'wml' AND b.series = 'mkt'), (SELECT stddev_samp(ret) FILTER (series = 'wml') AS sw, stddev_samp(ret) FILTER (series = 'mkt') AS sm FROM series_month WHERE month IN (SELECT month FROM series_month WHERE series = 'wml') AND month IN (SELECT month FROM series_month WHERE series = 'mkt'))", floats="ir")
def g17(spark, d):
    m = months(spark, d)
    both = m.where("series = 'wml'").select("month", F.col("ret").alias("w")).join(m.where("series = 'mkt'").select("month", F.col("ret").alias("m")), "month")
    sd = both.agg(F.stddev_samp("w").alias("sw"), F.stddev_samp("m").alias("sm"))
    return both.join(F.broadcast(sd)).agg(metrics.sharpe(F.col("w") / F.col("sw") - F.col("m") / F.col("sm")).alias("ir"))


@query("G18_mv_certainty", "SELECT series, g AS gamma, (avg(ret) - g / 2.0 * var_pop(ret)) * 1200 AS ce FROM series_month, (VALUES (2), (5), (10), (20)) v(g) GROUP BY series, g", floats="ce")
def g18(spark, d):
    each = months(spark, d).withColumn("gamma", F.explode(F.array(*map(F.lit, (2, 5, 10, 20)))))
    return each.groupBy("series", "gamma").agg(metrics.mv_certainty("ret", F.col("gamma")).alias("ce"))


@query("G19_crra_certainty", "SELECT series, CASE WHEN min(1 + ret) > 0 THEN pow(exp(avg(ln(1 + ret))), 12) - 1 END AS log_ce, CASE WHEN min(1 + ret) > 0 THEN pow(pow(avg(pow(1 + ret, -4)), 1 / (1 - 5.0)), 12) - 1 END AS ce5 FROM series_month GROUP BY 1", floats="log_ce ce5")
def g19(spark, d):
    return months(spark, d).groupBy("series").agg(metrics.crra_certainty("ret", 1).alias("log_ce"), metrics.crra_certainty("ret", 5).alias("ce5"))


BEAR = "bears AS (SELECT series, month, ret, CASE WHEN avg(ret) OVER (PARTITION BY series ORDER BY month ROWS 23 PRECEDING) < 0 THEN 1 ELSE 0 END AS bear FROM series_month)"


def bears(spark, d):
    return months(spark, d).withColumn("bear", F.when(F.avg("ret").over(by_month().rowsBetween(-23, 0)) < 0, 1).otherwise(0))


@query("G20_conditional_mean", "SELECT series, bear, avg(ret) AS mean, count(*) AS n FROM bears GROUP BY ALL", BEAR, floats="mean")
def g20(spark, d):
    return bears(spark, d).groupBy("series", "bear").agg(F.avg("ret").alias("mean"), F.count("*").alias("n"))


@query("G21_subperiods", "SELECT series, CASE WHEN month < DATE '1998-06-30' THEN 1 ELSE 2 END AS half, skewness_pop AS skew, worst FROM (SELECT series, CASE WHEN month < DATE '1998-06-30' THEN 1 ELSE 2 END AS h, min(month) AS month, (avg(ret * ret * ret) - 3 * avg(ret) * avg(ret * ret) + 2 * avg(ret) ^ 3) / pow(var_pop(ret), 1.5) AS skewness_pop, arg_min(month, ret) AS worst FROM series_month GROUP BY ALL)", floats="skew", digits=4, dates="worst")
def g21(spark, d):
    h = F.when(F.col("month") < "1998-06-30", 1).otherwise(2)
    return months(spark, d).groupBy("series", h.alias("half")).agg(F.skewness("ret").alias("skew"), F.min_by("month", "ret").alias("worst"))


@query("G22_worst_months", "SELECT series, month, ret FROM series_month QUALIFY row_number() OVER (PARTITION BY series ORDER BY ret, month) <= 5", floats="ret", dates="month")
def g22(spark, d):
    w = W.partitionBy("series").orderBy("ret", "month")
    return months(spark, d).withColumn("_rn", F.row_number().over(w)).where("_rn <= 5").select("series", "month", "ret")


@query("G23_summary", "SELECT series, avg(ret) AS mean, median(ret) AS mid FROM series_month GROUP BY 1", floats="mean mid")
def g23(spark, d):
    return months(spark, d).groupBy("series").agg(F.avg("ret").alias("mean"), F.percentile("ret", 0.5).alias("mid"))


@query("G24_max_difference", "SELECT max(abs(w.ret - l.ret)) AS diff FROM series_month w JOIN series_month l USING (month) WHERE w.series = 'win' AND l.series = 'los'", floats="diff")
def g24(spark, d):
    m = months(spark, d)
    return m.where("series = 'win'").select("month", "ret").join(m.where("series = 'los'").select("month", F.col("ret").alias("o")), "month").agg(F.max(F.abs(F.col("ret") - F.col("o"))).alias("diff"))


@query("G25_dispersion", "SELECT month, stddev_samp(sig) AS disp, count(*) AS n FROM signal GROUP BY 1", SIGNAL, floats="disp", dates="month")
def g25(spark, d):
    return legs.momentum(c.px_month(spark, d)).groupBy("month").agg(F.stddev_samp("sig").alias("disp"), F.count("*").alias("n"))


BUCKETS = SIGNAL + """, elig AS (SELECT * FROM signal QUALIFY count(*) OVER (PARTITION BY month) >= 15),
sedges AS (SELECT month, list_sort(list_distinct(quantile_cont(sig, [CAST(0 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.4 AS DOUBLE), CAST(0.6 AS DOUBLE), CAST(0.8 AS DOUBLE), CAST(1 AS DOUBLE)]))) AS e FROM elig GROUP BY 1),
bk AS (SELECT elig.*, len(list_filter(e[2:-2], lambda x: x < sig)) AS bucket, len(e) - 2 AS last FROM elig JOIN sedges USING (month)),
members AS (SELECT month, k, code, CASE WHEN bucket = last THEN 'win' ELSE 'los' END AS leg, cap AS w0 FROM bk WHERE bucket = last OR bucket = 0)"""


def members(spark, d):
    return legs.extremes(legs.momentum(c.px_month(spark, d)), 5)


@query("G26_book_spread", "SELECT m.k, median(1 / pbr) FILTER (leg = 'los') - median(1 / pbr) FILTER (leg = 'win') AS spread FROM members m JOIN px_month p ON m.k = p.k AND m.code = p.code GROUP BY 1", BUCKETS, floats="spread")
def g26(spark, d):
    j = members(spark, d).join(c.px_month(spark, d).select("k", "code", (1 / F.col("pbr")).alias("bm")), ["k", "code"])
    mid = lambda leg: F.percentile(F.when(F.col("leg") == leg, F.col("bm")), F.lit(0.5))
    return j.groupBy("k").agg((mid("los") - mid("win")).alias("spread"))


@query("G27_resumptions", "SELECT count(*) AS n, median(abs(jump)) AS mid FROM (SELECT di - lag(di) OVER w AS gap, adj_close / lag(adj_close) OVER w - 1 AS jump FROM px_day JOIN days USING (date) WINDOW w AS (PARTITION BY code ORDER BY di)) WHERE gap > 1", floats="mid")
def g27(spark, d):
    px = c.px_day(spark, d)
    w = W.partitionBy("code").orderBy("di")
    j = px.join(calendar.ordinals(px, "date", "di"), "date").select((F.col("di") - F.lag("di").over(w)).alias("gap"), (F.try_divide(F.col("adj_close"), F.lag("adj_close").over(w)) - 1).alias("jump"))
    return j.where("gap > 1").agg(F.count("*").alias("n"), F.percentile(F.abs("jump"), F.lit(0.5)).alias("mid"))


@query("W01_rolling_vol", "SELECT series, date, w, v FROM (SELECT series, date, 21 AS w, CASE WHEN count(*) OVER a >= 21 THEN sqrt(sum(r * r) OVER a * 252 / 21) END AS v FROM series_day WINDOW a AS (PARTITION BY series ORDER BY date ROWS 20 PRECEDING) UNION ALL SELECT series, date, 63, CASE WHEN count(*) OVER a >= 63 THEN sqrt(sum(r * r) OVER a * 252 / 63) END FROM series_day WINDOW a AS (PARTITION BY series ORDER BY date ROWS 62 PRECEDING) UNION ALL SELECT series, date, 126, CASE WHEN count(*) OVER a >= 126 THEN sqrt(sum(r * r) OVER a * 252 / 126) END FROM series_day WINDOW a AS (PARTITION BY series ORDER BY date ROWS 125 PRECEDING) UNION ALL SELECT series, date, 252, CASE WHEN count(*) OVER a >= 252 THEN sqrt(sum(r * r) OVER a * 252 / 252) END FROM series_day WINDOW a AS (PARTITION BY series ORDER BY date ROWS 251 PRECEDING)) WHERE v IS NOT NULL", floats="v", dates="date")
def w01(spark, d):
    s = c.series_day(spark, d)
    for w in (21, 63, 126, 252):
        s = s.withColumn(str(w), rolling.annual_vol("r", rolling.trailing(["series"], "date", w), w))
    return s.unpivot(["series", "date"], ["21", "63", "126", "252"], "w", "v").where("v is not null").withColumn("w", F.col("w").cast("int"))


@query("W02_variance_forecast", "SELECT series, month, fvar FROM fvar", floats="fvar", digits=8, dates="month")
def w02(spark, d):
    return race.variance_features(c.series_day(spark, d))


@query("W03_min_periods", "SELECT series, date, CASE WHEN count(*) OVER a >= 100 THEN 21 * avg(r * r) OVER a END AS v FROM series_day WINDOW a AS (PARTITION BY series ORDER BY date ROWS 125 PRECEDING)", floats="v", digits=8, dates="date")
def w03(spark, d):
    return c.series_day(spark, d).select("series", "date", rolling.variance_forecast("r", rolling.trailing(["series"], "date", 126), 100).alias("v"))


@query("W04_monthly_windows", "SELECT series, month, CASE WHEN count(*) OVER a >= 6 THEN avg(ret) OVER a END AS mean, CASE WHEN count(*) OVER a >= 6 THEN stddev_samp(ret) OVER a END AS sd, CASE WHEN count(*) OVER b >= 24 THEN sum(ret) OVER b END AS total FROM series_month WINDOW a AS (PARTITION BY series ORDER BY month ROWS 5 PRECEDING), b AS (PARTITION BY series ORDER BY month ROWS 23 PRECEDING)", floats="mean sd total", dates="month")
def w04(spark, d):
    a, b = (rolling.trailing(["series"], "month", n) for n in (6, 24))
    return months(spark, d).select("series", "month", rolling.full(F.avg("ret"), "ret", a, 6).alias("mean"), rolling.full(F.stddev_samp("ret"), "ret", a, 6).alias("sd"), rolling.full(F.sum("ret"), "ret", b, 24).alias("total"))


@query("W05_beta", "SELECT date, beta, beta * beta * vm * 1e4 AS market, (v - beta * beta * vm) * 1e4 AS specific FROM (SELECT date, count(*) OVER a AS n, covar_samp(wml, mkt) OVER a / var_samp(mkt) OVER a AS beta, var_samp(mkt) OVER a AS vm, var_samp(wml) OVER a AS v FROM factor_day WHERE wml IS NOT NULL WINDOW a AS (ORDER BY date ROWS 125 PRECEDING)) WHERE n >= 126", floats="beta market specific", digits=4, dates="date")
def w05(spark, d):
    a = rolling.trailing(["_block"], "t", 126)
    f = calendar.with_ordinal(c.factor_day(spark, d).where("wml is not null"), "date", "t")
    f = scans.overlapping(f, "t", 126).select("date", "_own", F.count("*").over(a).alias("n"), F.covar_samp("wml", "mkt").over(a).alias("cv"), F.var_samp("mkt").over(a).alias("vm"), F.var_samp("wml").over(a).alias("v")).where("_own and n >= 126")
    b = F.try_divide("cv", "vm")
    return f.select("date", b.alias("beta"), (b * b * F.col("vm") * 1e4).alias("market"), ((F.col("v") - b * b * F.col("vm")) * 1e4).alias("specific"))


@query("W06_index_level", "SELECT series, date, ln(level) AS log_level FROM lv WHERE series IN ('wml', 'mkt')", LEVEL, floats="log_level", dates="date")
def w06(spark, d):
    return levels(spark, d).where("series in ('wml', 'mkt')").select("series", "date", F.ln("level").alias("log_level"))


@query("W07_changes", "SELECT series, date, level / lag(level, 21) OVER w - 1 AS c21, level / lag(level, 252) OVER w - 1 AS c252 FROM lv WINDOW w AS (PARTITION BY series ORDER BY date)", LEVEL, floats="c21 c252", dates="date")
def w07(spark, d):
    ch = lambda k: rolling.change("level", ["series"], "date", k)
    return levels(spark, d).select("series", "date", ch(21).alias("c21"), ch(252).alias("c252"))


@query("W08_drawdown", "SELECT series, date, level / max(level) OVER (PARTITION BY series ORDER BY date) - 1 AS dd FROM lv", LEVEL, floats="dd", dates="date")
def w08(spark, d):
    return levels(spark, d).select("series", "date", rolling.drawdown("level", ["series"], "date").alias("dd"))


@query("W09_bear_rebound", "SELECT series, date, CASE WHEN c504 < 0 THEN 1.0 ELSE 0.0 END AS bear, CASE WHEN c504 < 0 AND c21 > 0 THEN 1.0 ELSE 0.0 END AS rebound FROM (SELECT series, date, round(level / lag(level, 504) OVER w - 1, 9) AS c504, round(level / lag(level, 21) OVER w - 1, 9) AS c21 FROM lv WINDOW w AS (PARTITION BY series ORDER BY date)) WHERE c504 IS NOT NULL", LEVEL, floats="bear rebound", dates="date")
def w09(spark, d):
    ch = lambda k: F.round(rolling.change("level", ["series"], "date", k), 9)
    x = levels(spark, d).select("series", "date", ch(504).alias("c504"), ch(21).alias("c21")).where("c504 is not null")
    return x.select("series", "date", F.expr("double(c504 < 0)").alias("bear"), F.expr("double(c504 < 0 and c21 > 0)").alias("rebound"))


@query("W09b_bear_monthly", "SELECT series, month, CASE WHEN round(total, 9) < 0 THEN 1.0 ELSE 0.0 END AS bear FROM (SELECT series, month, sum(ret) OVER a AS total, count(*) OVER a AS n FROM series_month WINDOW a AS (PARTITION BY series ORDER BY month ROWS 23 PRECEDING)) WHERE n >= 24", floats="bear", dates="month")
def w09b(spark, d):
    """The bear flag of monthly panels: the sum of 24 months' returns is negative."""
    total = rolling.full(F.sum("ret"), "ret", rolling.trailing(["series"], "month", 24), 24)
    return months(spark, d).select("series", "month", total.alias("total")).where("total is not null").select("series", "month", F.expr("double(round(total, 9) < 0)").alias("bear"))


@query("W10_forward_window", "SELECT series, month, CASE WHEN count(*) OVER a = 12 THEN stddev_samp(ret) OVER a * sqrt(12) END AS vol, CASE WHEN count(*) OVER a = 12 THEN product(1 + ret) OVER a - 1 END AS ret FROM series_month WINDOW a AS (PARTITION BY series ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)", floats="vol ret", dates="month")
def w10(spark, d):
    a = rolling.forward(["series"], "month")
    return months(spark, d).select("series", "month", (rolling.full(F.stddev_samp("ret"), "ret", a, 12) * F.sqrt(F.lit(12.0))).alias("vol"), (rolling.full(F.product(1 + F.col("ret")), "ret", a, 12) - 1).alias("ret"))


@query("W11_expanding_mean", "SELECT series, t, avg(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM race", floats="f", digits=8)
def w11(spark, d):
    return race_of(spark, d).select("series", "t", F.avg("y").over(rolling.expanding_before(["series"], "t")).alias("f"))


@query("W12_ewma", "SELECT series, t, lam, f FROM ewma", floats="f", digits=8)
def w12(spark, d):
    return race.ewmas(race_of(spark, d))


@query("W13_abs_difference", "SELECT series, month, abs(ret - coalesce(lag(ret) OVER w, ret)) AS diff FROM series_month WINDOW w AS (PARTITION BY series ORDER BY month)", floats="diff", dates="month")
def w13(spark, d):
    return months(spark, d).select("series", "month", F.abs(F.col("ret") - F.coalesce(F.lag("ret").over(by_month()), F.col("ret"))).alias("diff"))


@query("W14_quarterly_hold", "SELECT series, t, first_value(fvar) OVER (PARTITION BY series, t // 3 ORDER BY t) AS held FROM race", floats="held", digits=8)
def w14(spark, d):
    w = W.partitionBy("series", F.floor(F.col("t") / 3)).orderBy("t")
    return race_of(spark, d).select("series", "t", F.first("fvar").over(w).alias("held"))


@query("W15_win_rate", "SELECT series, avg(CASE WHEN sw > sm THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n FROM (SELECT a.series, count(*) OVER w AS n, round(avg(a.ret) OVER w / stddev_pop(a.ret) OVER w, 9) AS sw, round(avg(b.ret) OVER w / stddev_pop(b.ret) OVER w, 9) AS sm FROM series_month a JOIN series_month b USING (month) WHERE b.series = 'mkt' WINDOW w AS (PARTITION BY a.series ORDER BY month ROWS 59 PRECEDING)) WHERE n = 60 GROUP BY 1", floats="rate")
def w15(spark, d):
    m = months(spark, d).select("series", "month", "ret")
    a = rolling.trailing(["series"], "month", 60)
    s = lambda x: F.round(F.avg(x).over(a) / F.stddev_pop(x).over(a), 9)
    j = m.join(m.where("series = 'mkt'").select("month", F.col("ret").alias("b")), "month").select("series", F.count("*").over(a).alias("n"), s("ret").alias("sw"), s("b").alias("sm")).where("n = 60")
    return j.groupBy("series").agg(F.avg(F.expr("double(sw > sm)")).alias("rate"), F.count("*").alias("n"))


@query("W15b_win_rate_tail", "SELECT series, avg(CASE WHEN ew >= em THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n FROM (SELECT series, round(list_avg(list_sort(la)[1:3]), 9) AS ew, round(list_avg(list_sort(lb)[1:3]), 9) AS em FROM (SELECT a.series, list(a.ret) OVER w AS la, list(b.ret) OVER w AS lb, count(*) OVER w AS n FROM series_month a JOIN series_month b USING (month) WHERE b.series = 'mkt' WINDOW w AS (PARTITION BY a.series ORDER BY month ROWS 59 PRECEDING)) WHERE n = 60) GROUP BY 1", floats="rate")
def w15b(spark, d):
    """How often a window's mean of its three worst of 60 months is no worse than the market's."""
    m, a = months(spark, d).select("series", "month", "ret"), rolling.trailing(["series"], "month", 60)
    worst = lambda x: F.round(F.aggregate(F.slice(F.array_sort(F.collect_list(x).over(a)), 1, 3), F.lit(0.0), lambda s, v: s + v) / 3, 9)
    j = m.join(m.where("series = 'mkt'").select("month", F.col("ret").alias("b")), "month").select("series", F.count("*").over(a).alias("n"), worst("ret").alias("ew"), worst("b").alias("em")).where("n = 60")
    return j.groupBy("series").agg(F.avg(F.expr("double(ew >= em)")).alias("rate"), F.count("*").alias("n"))


@query("W16_rank", "SELECT k, code, rank() OVER (PARTITION BY k ORDER BY ret DESC) + (count(*) OVER (PARTITION BY k, ret) - 1) / 2.0 AS rnk FROM px_month", floats="rnk")
def w16(spark, d):
    return c.px_month(spark, d).select("k", "code", rolling.mean_rank("ret", ["k"], ascending=False).alias("rnk"))


@query("W17_forward_fill", "SELECT code, date, last_value(ret IGNORE NULLS) OVER (PARTITION BY code ORDER BY date) AS ret FROM (SELECT DISTINCT date FROM line) CROSS JOIN (SELECT DISTINCT code FROM line) LEFT JOIN ret_day USING (code, date)", floats="ret", dates="date")
def w17(spark, d):
    """All brands' last daily return on every market day."""
    day = c.days(spark, d).select("date", "di")
    r = c.ret_day(spark, d).join(day, "date").select("code", "di", "ret")
    return reshape.carried(r, day, "code", "di", "ret").join(day, "di").select("code", "date", "ret")


@query("W18_vol_of_vol", "SELECT series, stddev_samp(x) AS vv FROM (SELECT series, ln(rv) - lag(ln(rv)) OVER (PARTITION BY series ORDER BY month) AS x FROM series_month WHERE rv > 0) GROUP BY 1", floats="vv")
def w18(spark, d):
    return months(spark, d).where("rv > 0").select("series", (F.ln("rv") - F.lag(F.ln("rv")).over(by_month())).alias("x")).groupBy("series").agg(F.stddev_samp("x").alias("vv"))


@query("W19_lagged_variance", "SELECT series, month, lag(v) OVER (PARTITION BY series ORDER BY month) AS v FROM (SELECT series, month, CASE WHEN count(*) OVER a = 6 THEN var_samp(ret) OVER a END AS v FROM series_month WINDOW a AS (PARTITION BY series ORDER BY month ROWS 5 PRECEDING))", floats="v", digits=8, dates="month")
def w19(spark, d):
    v = months(spark, d).withColumn("v", rolling.full(F.var_samp("ret"), "ret", rolling.trailing(["series"], "month", 6), 6))
    return v.select("series", "month", F.lag("v").over(by_month()).alias("v"))


@query("W20_lag_sequences", "SELECT series, t, list_aggregate(x, 'sum') AS total, len(x) AS n FROM (SELECT series, t, list(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x FROM race) WHERE len(x) = 12", floats="total", digits=8)
def w20(spark, d):
    x = F.collect_list("y").over(rolling.ordered(["series"], "t").rowsBetween(-12, -1))
    s = race_of(spark, d).withColumn("x", x).where(F.size("x") == 12)
    return s.select("series", "t", F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("total"), F.size("x").cast("long").alias("n"))


@query("G11b_quantiles_of_lines", "SELECT l_returnflag, unnest([CAST(0.01 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.99 AS DOUBLE)]) AS q, unnest(quantile_cont(l_extendedprice, [CAST(0.01 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.99 AS DOUBLE)])) AS value FROM lineitem GROUP BY 1", floats="value", digits=4)
def g11b(spark, d):
    """Exact quantiles of all lines' prices by flag: three groups that grow with the table."""
    return quantiles.exact_quantiles(c.table(spark, d, "lineitem"), "l_extendedprice", [0.01, 0.5, 0.99], ["l_returnflag"])


@query("Q01b_buckets_of_lines", "SELECT l_returnflag, CAST(len(list_filter(e, lambda x: x < l_extendedprice)) AS BIGINT) AS bucket, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem JOIN (SELECT l_returnflag, quantile_cont(l_extendedprice, [CAST(0.2 AS DOUBLE), CAST(0.4 AS DOUBLE), CAST(0.6 AS DOUBLE), CAST(0.8 AS DOUBLE)]) AS e FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY ALL", floats="low high", digits=2)
def q01b(spark, d):
    """Fifths of all lines by price and flag."""
    lines = c.table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    return quantiles.large_group_buckets(lines, "l_extendedprice", 5, ["l_returnflag"]).groupBy("l_returnflag", "bucket").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("X01_tumbling_windows", "SELECT epoch_us(date_trunc('day', CAST(ts AS TIMESTAMP))) AS start, CAST(event_type AS VARCHAR) AS event_type, sum(value * value) AS rv, count(*) AS n FROM events GROUP BY ALL", floats="rv", digits=4)
def x01(spark, d):
    """The batch form of the stream's daily sums of squares."""
    e = c.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return daily_risk.tumbling_variance(e, "ts", "event_type", "value").withColumn("start", F.unix_micros("start"))


@query("X03_sliding_windows", "SELECT epoch_us(date_trunc('day', CAST(ts AS TIMESTAMP))) - back * 86400000000 AS start, CAST(event_type AS VARCHAR) AS event_type, sum(value * value) AS rv, count(*) AS n FROM events, (SELECT unnest(range(2)) AS back) GROUP BY ALL", floats="rv", digits=4)
def x03(spark, d):
    """Sums of squares over two days, from every day on."""
    e = c.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return daily_risk.sliding_variance(e, "ts", "event_type", "value").withColumn("start", F.unix_micros("start"))


@query("X02_session_windows", "SELECT min(us) AS start, max(us) + 1800000000 AS \"end\", user_id, count(*) AS n FROM (SELECT *, sum(CASE WHEN us - prev < 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS us, lag(epoch_us(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) GROUP BY user_id, s")
def x02(spark, d):
    """A user's events no more than half an hour apart are one session."""
    e = c.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return daily_risk.sessions(e, "ts", "user_id").withColumns({k: F.unix_micros(k) for k in ("start", "end")})


@query("Q01_quantile_buckets", "SELECT month, code, bucket FROM bk", BUCKETS, dates="month")
def q01(spark, d):
    return sorts.quantile_buckets(legs.eligible(legs.momentum(c.px_month(spark, d)), 5), "sig", 5, ["month"]).select("month", "code", "bucket")


@query("Q02_splits", "SELECT k, quantile_cont(cap, CAST(0.5 AS DOUBLE)) AS med, quantile_cont(ret, CAST(0.3 AS DOUBLE)) AS p30, quantile_cont(ret, CAST(0.7 AS DOUBLE)) AS p70 FROM px_month GROUP BY 1", floats="med p30 p70", digits=4)
def q02(spark, d):
    return c.px_month(spark, d).groupBy("k").agg(F.percentile("cap", 0.5).alias("med"), F.percentile("ret", 0.3).alias("p30"), F.percentile("ret", 0.7).alias("p70"))


@query("Q03_size_half", "SELECT k, code FROM px_month QUALIFY cap >= quantile_cont(cap, CAST(0.5 AS DOUBLE)) OVER (PARTITION BY k)")
def q03(spark, d):
    p = c.px_month(spark, d)
    return p.join(sorts.quantile_of(p, "cap", 0.5, ["k"], "med"), "k").where("cap >= med").select("k", "code")


@query("O01_leaderboard", "SELECT code, avg(ret) AS mean FROM ret_day GROUP BY 1 ORDER BY mean", floats="mean")
def o01(spark, d):
    return c.ret_day(spark, d).groupBy("code").agg(F.avg("ret").alias("mean")).orderBy("mean")


@query("O02_top_k", "SELECT code, cap FROM (SELECT code, count(*) AS cap FROM line GROUP BY 1) ORDER BY cap DESC, code LIMIT 5")
def o02(spark, d):
    return c.lines(spark, d).groupBy("code").agg(F.count("*").alias("cap")).orderBy(F.desc("cap"), "code").limit(5)


@query("O03_argmax", "SELECT series, arg_max(month, ret) AS best, arg_min(month, ret) AS worst FROM series_month GROUP BY 1", dates="best worst")
def o03(spark, d):
    return months(spark, d).groupBy("series").agg(F.max_by("month", "ret").alias("best"), F.min_by("month", "ret").alias("worst"))


@query("O04_concat", "SELECT series, count(*) AS n FROM (SELECT * FROM series_day WHERE date < DATE '1998-01-01' UNION ALL SELECT * FROM series_day WHERE date >= DATE '1998-01-01') GROUP BY 1")
def o04(spark, d):
    s = c.series_day(spark, d)
    return s.where("date < '1998-01-01'").unionByName(s.where("date >= '1998-01-01'")).groupBy("series").agg(F.count("*").alias("n"))


@query("O05_set_union", "SELECT month FROM cal WHERE k < 30 UNION SELECT month FROM rf_month INTERSECT SELECT month FROM cal", dates="month")
def o05(spark, d):
    m = c.months(spark, d)
    return m.where("k < 30").select("month").union(c.rf_month(spark, d).select("month").intersect(m.select("month"))).distinct()


@query("O06_difference", "SELECT month FROM cal EXCEPT SELECT month FROM cal WHERE k % 5 = 0", dates="month")
def o06(spark, d):
    m = c.months(spark, d)
    return m.select("month").subtract(m.where("k % 5 = 0").select("month"))
