"""Queries over the panel: scans, reshaping, calendars, joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.operators import calendar, legs, race, reshape, scans, sorts
from factorloom.plans.registry import query
from factorloom.sources import catalog as c
from factorloom.sources import digests, files, workbook
from factorloom.sources.shared import stored_path


@query("S01_panel_scan", "SELECT date, code, adj_close FROM px_day WHERE adj_close > 0", floats="adj_close", digits=4, dates="date")
def s01(spark, d):
    return c.px_day(spark, d).where("adj_close > 0").select("date", "code", "adj_close")


@query("S02_panel_slice", "SELECT date, code, ret FROM ret_day WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'", floats="ret", dates="date")
def s02(spark, d):
    return c.ret_day(spark, d).where("date between '1997-01-01' and '1997-12-31'").select("date", "code", "ret")


@query("S03_csv_scan", "SELECT date, wml FROM factor_day WHERE wml IS NOT NULL", floats="wml", dates="date")
def s03(spark, d):
    return files.csv_round_trip(c.factor_day(spark, d).select("date", F.round("wml", 12).alias("wml")).where("wml is not null"))


@query("S04_period_csv", "SELECT month, rf FROM rf_month", floats="rf", digits=8, dates="month")
def s04(spark, d):
    text = files.csv_round_trip(c.rf_month(spark, d).select(F.date_format("month", "yyyy-MM").alias("period"), F.round("rf", 12).alias("rf")))
    return text.select(F.last_day(F.to_date("period", "yyyy-MM")).alias("month"), "rf")


@query("S05_wide_sheet", "SELECT code, month, pbr FROM px_month WHERE pbr > 0", floats="pbr", dates="month")
def s05(spark, d):
    wide = c.px_month(spark, d).groupBy("code").pivot("month").agg(F.first("pbr"))
    return files.unpivot_sheet(wide, "code", "month", "pbr")


@query("S05b_sheet_universe", "SELECT code, month, pbr FROM px_month WHERE code IN (SELECT p_brand FROM part WHERE p_size = 1)", floats="pbr", dates="month")
def s05b(spark, d):
    wide = c.px_month(spark, d).groupBy("code").pivot("month").agg(F.first("pbr"))
    names = c.table(spark, d, "part").where("p_size = 1").select(F.col("p_brand").alias("code")).distinct()
    return files.unpivot_sheet(wide, "code", "month", "pbr").join(names, "code", "left_semi")


@query("S05c_workbook", "SELECT code, month AS date, pbr AS value FROM px_month WHERE pbr > 0", floats="value", dates="date")
def s05c(spark, d):
    """The same panel through a workbook: dated header found by its marks, months' last columns, positive numbers."""
    return workbook.read(workbook.write(c.px_month(spark, d).select("code", "month", "pbr"), "code", "month", "pbr"))


@query("S06_sectioned_file", "SELECT date, CASE WHEN series = 'los' THEN 'd1' ELSE 'd2' END AS name, r AS value FROM series_day WHERE series IN ('los', 'win')", floats="value", dates="date")
def s06(spark, d):
    wide = c.series_day(spark, d).where("series in ('los', 'win')").groupBy("date").pivot("series", ["los", "win"]).agg(F.first("r"))
    return files.sectioned(files.write_sectioned(wide.select("date", F.col("los").alias("d1"), F.col("win").alias("d2")), "Average Returns -- Daily"), "Average Returns -- Daily", ["d1", "d2"]).where("value is not null")


@query("S12_markdown_table", "SELECT 0 AS at, '| series | month | ret | rv |' AS line UNION ALL SELECT 1, '| --- | --- | --- | --- |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY series, month), printf('| %s | %s | %.4f | %.4f |', series, CAST(CAST(month AS DATE) AS VARCHAR), ret * 100, rv * 10000) FROM series_month")
def s12(spark, d):
    """Monthly returns in per cent and variances of all series as the lines of a Markdown table."""
    m = race.months(c.series_day(spark, d)).select("series", "month", (F.col("ret") * 100).alias("ret"), (F.col("rv") * 10000).alias("rv"))
    return files.markdown_lines(m, ["series", "month"])


@query("S08_rate_series", "SELECT month, pow(1 + rf * 1000 / 100, 1 / 12.0) - 1 AS monthly FROM rf_month", floats="monthly", digits=8, dates="month")
def s08(spark, d):
    return c.rf_month(spark, d).select("month", calendar.annual_percent_to_month(F.col("rf") * 1000).alias("monthly"))


@query("S08b_rate_compare", "SELECT max(abs(rf - round(rf, 4))) AS difference FROM rf_month", floats="difference", digits=9)
def s08b(spark, d):
    """A rate file with four digits, read back and compared with the rates."""
    rates = c.rf_month(spark, d).select("month", "rf")
    back = files.csv_round_trip(rates.select("month", F.round("rf", 4).alias("rf")))
    return files.compared(rates, back, ["month"], "rf")


@query("S09_listing_filter", "SELECT code, count(*) AS n FROM px_day WHERE code IN (SELECT p_brand FROM part WHERE p_type = 'PROMO' AND p_size <= 2) GROUP BY 1")
def s09(spark, d):
    listed = c.table(spark, d, "part").where("p_type = 'PROMO' and p_size <= 2").select(F.col("p_brand").alias("code")).distinct()
    return c.px_day(spark, d).join(listed, "code", "left_semi").groupBy("code").agg(F.count("*").alias("n"))


@query("S10_csv_sink", "SELECT series, month, ret, rv FROM series_month", floats="ret rv", dates="month")
def s10(spark, d):
    m = c.series_day(spark, d).groupBy("series", F.last_day("date").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("ret"), F.sum(F.col("r") * F.col("r")).alias("rv"))
    return files.csv_round_trip(m.select("series", "month", F.round("ret", 10).alias("ret"), F.round("rv", 10).alias("rv")))


@query("S11_parquet_sink", "SELECT code, month, pbr FROM px_month", floats="pbr", dates="month")
def s11(spark, d):
    return files.parquet_round_trip(c.px_month(spark, d).select("code", "month", "pbr"))


@query("S13_json_bundle", "SELECT series, to_json({'n': n, 'last': last}) AS bundle FROM (SELECT series, count(*) AS n, CAST(max(date) AS VARCHAR) AS last FROM series_day GROUP BY 1)")
def s13(spark, d):
    return c.series_day(spark, d).groupBy("series").agg(F.count("*").alias("n"), F.max("date").cast("string").alias("last")).select("series", F.to_json(F.struct("n", "last")).alias("bundle"))


@query("S14_figure_frames", "SELECT date, product(1 + wml) OVER (ORDER BY date) - 1 AS path FROM factor_day WHERE wml IS NOT NULL", floats="path", dates="date")
def s14(spark, d):
    f = calendar.with_ordinal(c.factor_day(spark, d).where("wml is not null"), "date", "n").withColumn("t", F.col("n") - 1)
    return scans.running_product(f, [], "t", 1 + F.col("wml"), "path").select("date", (F.col("path") - 1).alias("path"))


@query("S16_fingerprint")
def s16(spark, d):
    """Fingerprints of all table files against the manifest that the session's first run of this query over the folder has stored."""
    return digests.checked(spark, d, stored_path(spark, f"manifest of {d}"), "*.parquet")


@query("S17_literal_rows", "SELECT r_name AS name FROM region UNION ALL SELECT 'WORLD'")
def s17(spark, d):
    return c.table(spark, d, "region").select(F.col("r_name").alias("name")).unionByName(spark.createDataFrame([("WORLD",)], "name string"))


@query("P01_last_by_key", "SELECT code, month, arg_max(adj_close, date) AS last FROM (SELECT *, last_day(date) AS month FROM px_day) GROUP BY ALL", floats="last", digits=4, dates="month")
def p01(spark, d):
    return reshape.last_by_key(c.px_day(spark, d).withColumn("month", F.last_day("date")), "adj_close", "date", ["code", "month"], "last")


@query("P02_align", "SELECT code, c.month, p.ret FROM cal c CROSS JOIN (SELECT DISTINCT code FROM px_month) LEFT JOIN px_month p USING (code, month)", floats="ret", dates="month")
def p02(spark, d):
    """All brands' monthly returns on the whole calendar."""
    p = c.px_month(spark, d).select("code", "k", "ret")
    return reshape.aligned(p, c.months(spark, d), "code", "k").select("code", "month", "ret")


GUARDED = "guarded AS (SELECT date, code, CASE WHEN abs(ret) <= theta THEN ret END AS ret, theta FROM (SELECT px.date, px.code, CASE WHEN di - lag(di) OVER w = 1 THEN adj_close / lag(adj_close) OVER w - 1 END AS ret FROM px_day px JOIN days USING (date) WINDOW w AS (PARTITION BY code ORDER BY di)), (VALUES (CAST(0.3 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(1.0 AS DOUBLE)), (CAST('inf' AS DOUBLE))) g(theta))"


@query("P03_outlier_guard", "SELECT theta, count(ret) AS kept, avg(ret) AS mean FROM guarded GROUP BY 1", GUARDED, floats="mean")
def p03(spark, d):
    px = c.px_day(spark, d)
    r = legs.calendar_returns(px, calendar.ordinals(px, "date", "di"))
    grid = r.withColumn("theta", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(1.0), F.lit(float("inf")))))
    return grid.groupBy("theta").agg(F.count(reshape.guard("ret", "theta")).alias("kept"), F.avg(reshape.guard("ret", "theta")).alias("mean"))


@query("P04_melt", "SELECT * FROM series_day", floats="r", dates="date")
def p04(spark, d):
    return c.series_day(spark, d)


@query("P05_code_normalise", "SELECT DISTINCT code, CASE WHEN length(regexp_replace(regexp_replace(code, '^Brand#', 'A'), '^A+', '')) < 6 THEN lpad(regexp_replace(regexp_replace(code, '^Brand#', 'A'), '^A+', ''), 6, '0') ELSE regexp_replace(regexp_replace(code, '^Brand#', 'A'), '^A+', '') END AS norm FROM line")
def p05(spark, d):
    return c.lines(spark, d).select("code").distinct().withColumn("norm", reshape.normal_code(F.regexp_replace("code", "^Brand#", "A")))


@query("P06_coerce_positive", "SELECT count(*) AS n FROM orders WHERE try_cast(o_orderpriority[1:1] AS DOUBLE) > 2")
def p06(spark, d):
    o = c.table(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).alias("x"))
    return o.select(F.expr("try_cast(x as double)").alias("v")).where("v > 2").agg(F.count("*").alias("n"))


@query("P07_sentinels", "SELECT CAST(event_type AS VARCHAR) AS event_type, count(CASE WHEN round(value) NOT IN (7, 19) THEN value / 100 END) AS n, avg(CASE WHEN round(value) NOT IN (7, 19) THEN value / 100 END) AS mean FROM events GROUP BY 1", floats="mean")
def p07(spark, d):
    v = reshape.from_percent(F.col("value"), F.round("value"), [7.0, 19.0])
    return c.table(spark, d, "events").groupBy("event_type").agg(F.count(v).alias("n"), F.avg(v).alias("mean"))


@query("P08_clip", "SELECT series, avg(least(greatest(r, -0.01), 0.01)) AS mean FROM series_day GROUP BY 1", floats="mean", digits=8)
def p08(spark, d):
    return c.series_day(spark, d).groupBy("series").agg(F.avg(reshape.clip(F.col("r"), -0.01, 0.01)).alias("mean"))


@query("P10_null_fill", "SELECT code, date, coalesce(ret, 0.0) AS ret FROM (SELECT DISTINCT date FROM line) CROSS JOIN (SELECT DISTINCT code FROM line) LEFT JOIN ret_day USING (code, date)", floats="ret", dates="date")
def p10(spark, d):
    """All brands on every market day, without a trade at 0."""
    day = c.days(spark, d).select("date", "di")
    r = c.ret_day(spark, d).join(day, "date").select("code", "di", "ret")
    return reshape.aligned(r, day, "code", "di").select("code", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))


@query("P11_closed_ranges", "SELECT month, CASE WHEN month BETWEEN DATE '1997-03-31' AND DATE '1997-06-30' OR month BETWEEN DATE '1999-01-31' AND DATE '1999-02-28' THEN 0 ELSE ret END AS ret FROM series_month WHERE series = 'wml'", floats="ret", dates="month")
def p11(spark, d):
    m = c.series_day(spark, d).where("series = 'wml'").groupBy(F.last_day("date").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("ret"))
    return m.withColumn("ret", reshape.zero_in("month", F.col("ret"), [("1997-03-31", "1997-06-30"), ("1999-01-31", "1999-02-28")]))


@query("P12_common_sample", "SELECT count(*) AS n FROM (SELECT month, fvar FROM series_month LEFT JOIN fvar USING (series, month) WHERE series = 'wml') WHERE fvar IS NOT NULL")
def p12(spark, d):
    s = c.series_day(spark, d).where("series = 'wml'")
    return race.months(s).join(race.variance_features(s), ["series", "month"], "left").dropna(subset=["fvar"]).agg(F.count("*").alias("n"))


@query("P13_first_by_key", "SELECT date, code, adj_close FROM px_day QUALIFY row_number() OVER (PARTITION BY date ORDER BY code) = 1", floats="adj_close", digits=4, dates="date")
def p13(spark, d):
    return reshape.first_by_key(c.px_day(spark, d).select("date", "code", "adj_close"), ["date"], "code")


@query("P14_six_groups", "SELECT k, grp, count(*) AS n FROM (SELECT k, CASE WHEN cap < med THEN 'S' ELSE 'B' END || CASE WHEN bm <= p30 THEN 'L' WHEN bm >= p70 THEN 'H' ELSE 'M' END AS grp FROM (SELECT k, cap, 1 / pbr AS bm, quantile_cont(cap, CAST(0.5 AS DOUBLE)) OVER (PARTITION BY k) AS med, quantile_cont(1 / pbr, CAST(0.3 AS DOUBLE)) OVER (PARTITION BY k) AS p30, quantile_cont(1 / pbr, CAST(0.7 AS DOUBLE)) OVER (PARTITION BY k) AS p70 FROM px_month)) GROUP BY ALL")
def p14(spark, d):
    p = c.px_month(spark, d).withColumn("bm", 1 / F.col("pbr"))
    e = p.groupBy("k").agg(F.percentile("cap", 0.5).alias("med"), F.percentile("bm", 0.3).alias("p30"), F.percentile("bm", 0.7).alias("p70"))
    return p.join(e, "k").groupBy("k", sorts.corner(F.col("cap"), F.col("med"), F.col("bm"), F.col("p30"), F.col("p70")).alias("grp")).agg(F.count("*").alias("n"))


@query("P15_all_null", "SELECT code FROM ret_day GROUP BY 1 HAVING count(CASE WHEN ret > 1 THEN ret END) = 0")
def p15(spark, d):
    return c.ret_day(spark, d).groupBy("code").agg(F.count(F.when(F.col("ret") > 1, F.col("ret"))).alias("n")).where("n = 0").select("code")


@query("P15b_drop_all_null", "SELECT p_partkey, p_brand FROM part")
def p15b(spark, d):
    part = c.table(spark, d, "part").select("p_partkey", "p_brand", F.expr("cast(null as string)").alias("nothing"), F.when(F.col("p_size") < 0, F.lit(1)).alias("never"))
    return reshape.drop_all_null(part)


@query("P16_columns_by_name", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def p16(spark, d):
    o = c.table(spark, d, "orders")
    return o.select(*reshape.columns_named(o, prefix="o_order", without=["o_orderdate"]))


@query("P17_pivot_report", "SELECT 'mean' AS metric, avg(ret) FILTER (series = 'los') AS los, avg(ret) FILTER (series = 'win') AS win, avg(ret) FILTER (series = 'wml') AS wml FROM series_month", floats="los win wml")
def p17(spark, d):
    m = c.series_day(spark, d).groupBy("series", F.last_day("date").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("ret"))
    return reshape.report(m.groupBy("series").agg(F.avg("ret").alias("value")).withColumn("metric", F.lit("mean")), "metric", "series", ["los", "win", "wml"])


@query("P18_stack", "SELECT count(*) AS n, sum(r) AS total FROM series_day", floats="total")
def p18(spark, d):
    return c.series_day(spark, d).agg(F.count("*").alias("n"), F.sum("r").alias("total"))


@query("P19_segments", "SELECT name, count(*) AS n, avg(ret) AS mean FROM series_month JOIN (VALUES ('early', DATE '1995-01-31', DATE '1997-12-31'), ('late', DATE '1998-01-31', DATE '2001-12-31'), ('all', DATE '1990-01-31', DATE '2010-12-31')) g(name, a, b) ON month BETWEEN a AND b WHERE series = 'wml' GROUP BY 1", floats="mean")
def p19(spark, d):
    m = c.series_day(spark, d).where("series = 'wml'").groupBy(F.last_day("date").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("ret"))
    return reshape.segments(m, "month", [("early", "1995-01-31", "1997-12-31"), ("late", "1998-01-31", "2001-12-31"), ("all", "1990-01-31", "2010-12-31")]).groupBy("name").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"))


@query("P20_rounding", "SELECT code, avg(ret) AS mean FROM ret_day GROUP BY 1", floats="mean", digits=4)
def p20(spark, d):
    return c.ret_day(spark, d).groupBy("code").agg(F.avg("ret").alias("mean"))


@query("C01_month_end_days", "SELECT last_day(date) AS month, max(date) AS last_trade FROM line GROUP BY 1", dates="month last_trade")
def c01(spark, d):
    return calendar.month_end_days(c.lines(spark, d).select("date"))


@query("C02_month_stamp", "SELECT last_day(date) AS month, count(*) AS n FROM (SELECT DISTINCT date FROM line) GROUP BY 1", dates="month")
def c02(spark, d):
    return c.days(spark, d).select("date").groupBy(F.last_day("date").alias("month")).agg(F.count("*").alias("n"))


@query("C03_last_value", "SELECT code, last_day(date) AS month, arg_max(ret, date) AS ret FROM ret_day WHERE ret IS NOT NULL GROUP BY ALL", floats="ret", dates="month")
def c03(spark, d):
    return calendar.last_values(c.ret_day(spark, d), "ret", "code")


@query("C04_row_shift", "SELECT series, month, lag(ret) OVER w AS before, lead(ret) OVER w AS after FROM series_month WINDOW w AS (PARTITION BY series ORDER BY month)", floats="before after", dates="month")
def c04(spark, d):
    m = c.series_day(spark, d).groupBy("series", F.last_day("date").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("ret"))
    w = W.partitionBy("series").orderBy("month")
    return m.select("series", "month", F.lag("ret").over(w).alias("before"), F.lead("ret").over(w).alias("after"))


@query("C05_formation_dates", "SELECT year(month) AS year, max(month) FILTER (month(month) = 6) AS june, max(month) FILTER (month(month) = 12) AS december FROM cal GROUP BY 1", dates="june december")
def c05(spark, d):
    m = c.months(spark, d).select("month")
    pick = lambda n: F.max(F.when(F.month("month") == n, F.col("month")))
    return m.groupBy(F.year("month").cast("long").alias("year")).agg(pick(6).alias("june"), pick(12).alias("december"))


@query("C06_rate_conversion", "SELECT month, pow(1 + rf * 500 / 100, 1 / 12.0) - 1 AS rate FROM rf_month", floats="rate", digits=8, dates="month")
def c06(spark, d):
    return c.rf_month(spark, d).select("month", calendar.annual_percent_to_month(F.col("rf") * 500).alias("rate"))


@query("C07_month_arithmetic", "SELECT month, last_day(month + INTERVAL 1 MONTH - INTERVAL 3 DAY) AS _x, CAST(last_day(date_trunc('month', month) + INTERVAL 1 MONTH) AS DATE) AS next, CAST(last_day(date_trunc('month', month) - INTERVAL 1 MONTH) AS DATE) AS prev FROM cal".replace("last_day(month + INTERVAL 1 MONTH - INTERVAL 3 DAY) AS _x, ", ""), dates="month next prev")
def c07(spark, d):
    m = c.months(spark, d).select("month")
    return m.select("month", calendar.shift_month("month", 1).alias("next"), calendar.shift_month("month", -1).alias("prev"))


@query("C08_holding_window", "SELECT c.month, count(*) AS n, min(date) AS first, max(date) AS last FROM cal c JOIN days d ON d.k = c.k + 1 GROUP BY 1", dates="month first last")
def c08(spark, d):
    day = c.days(spark, d).select("date")
    m = calendar.ordinals(day.select(F.last_day("date").alias("month")), "month", "k")
    held = day.withColumn("month", F.last_day("date")).join(m, "month").select("date", (F.col("k") - 1).alias("k"))
    return m.join(held, "k").groupBy("month").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("C09_day_ordinal", "SELECT date, di FROM days", dates="date")
def c09(spark, d):
    return calendar.ordinals(c.lines(spark, d), "date", "di")


SEEN = "thin AS (SELECT * FROM px_day WHERE NOT (code < 'Brand#2' AND date > DATE '2000-06-30'))"


def thin(spark, d):
    """The panel with some brands gone from July 2000 on."""
    return c.px_day(spark, d).where("not (code < 'Brand#2' and date > '2000-06-30')")


@query("C10_delisting_rows", "SELECT code, max(di) + 1 AS di FROM thin JOIN (SELECT date, row_number() OVER (ORDER BY date) AS di FROM (SELECT DISTINCT date FROM thin)) USING (date) GROUP BY 1 HAVING max(di) < (SELECT count(DISTINCT date) FROM thin) - 30", SEEN)
def c10(spark, d):
    return calendar.delisting_events(thin(spark, d))


@query("C10b_delisting_days", "SELECT code, max(date) AS last_seen FROM thin GROUP BY 1 HAVING max(date) < (SELECT max(date) FROM thin) - 30", SEEN, dates="last_seen")
def c10b(spark, d):
    return calendar.delisted_by_date(thin(spark, d))


@query("J01_inner", "SELECT m.month, ret, rf FROM series_month m JOIN rf_month USING (month) WHERE series = 'mkt'", floats="ret rf", dates="month")
def j01(spark, d):
    m = c.series_day(spark, d).where("series = 'mkt'").groupBy(F.last_day("date").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("ret"))
    return m.join(c.rf_month(spark, d), "month")


@query("J02_left", "SELECT c.month, rf FROM cal c LEFT JOIN (SELECT * FROM rf_month WHERE year(month) < 1998) USING (month)", floats="rf", dates="month")
def j02(spark, d):
    m = c.months(spark, d).select("month")
    return m.join(c.rf_month(spark, d).where("year(month) < 1998"), "month", "left")


FIVE = "(SELECT month, ret AS a FROM px_month WHERE code = 'Brand#11' AND k % 3 = 0) a FULL JOIN (SELECT month, ret AS b FROM px_month WHERE code = 'Brand#12' AND k % 2 = 0) b USING (month)"


@query("J03_full_outer", f"SELECT month, a, b FROM {FIVE}", floats="a b", dates="month")
def j03(spark, d):
    p = c.px_month(spark, d)
    return p.where("code = 'Brand#11' and k % 3 = 0").select("month", F.col("ret").alias("a")).join(p.where("code = 'Brand#12' and k % 2 = 0").select("month", F.col("ret").alias("b")), "month", "full")


@query("J04_intersection", "SELECT month FROM px_month WHERE code = 'Brand#11' INTERSECT SELECT month FROM rf_month INTERSECT SELECT month FROM px_month WHERE code = 'Brand#21'", dates="month")
def j04(spark, d):
    p = c.px_month(spark, d)
    return p.where("code = 'Brand#11'").select("month").intersect(c.rf_month(spark, d).select("month")).intersect(p.where("code = 'Brand#21'").select("month"))


@query("J05_merge", "SELECT code, a.ret AS ret, b.ret AS later FROM px_month a JOIN px_month b USING (code) WHERE a.k = 1 AND b.k = 20", floats="ret later")
def j05(spark, d):
    p = c.px_month(spark, d)
    return p.where("k = 1").select("code", "ret").join(p.where("k = 20").select("code", F.col("ret").alias("later")), "code")


@query("J06_asof_backward", "SELECT c.month, max(o.month) AS latest FROM cal c LEFT JOIN (SELECT month FROM cal WHERE k % 4 = 0) o ON o.month <= c.month GROUP BY 1", dates="month latest")
def j06(spark, d):
    m = c.months(spark, d)
    return reshape.as_of(m.select("month"), m.where("k % 4 = 0").select(F.col("month").alias("latest")), "month", "latest")


@query("J07_asof_series", "SELECT c.month, arg_max(wml, date) AS wml FROM cal c JOIN factor_day f ON f.date <= CAST(last_day(date_trunc('month', c.month) - INTERVAL 1 MONTH) AS DATE) AND wml IS NOT NULL GROUP BY 1", floats="wml", dates="month")
def j07(spark, d):
    f = c.factor_day(spark, d).where("wml is not null").select(F.col("date").alias("latest"), "wml")
    m = c.months(spark, d).select("month").withColumn("before", calendar.shift_month("month", -1))
    found = reshape.as_of(m.select(F.col("before")), f.select("latest"), "before", "latest").where("latest is not null")
    return m.join(found, "before").join(f, "latest").select("month", "wml")


@query("J08_band_join", "SELECT f.month, code, count(*) AS n FROM cal f JOIN days d ON d.k = f.k + 1 JOIN ret_day USING (date) GROUP BY ALL", dates="month")
def j08(spark, d):
    r = c.ret_day(spark, d)
    m = calendar.ordinals(r.select(F.last_day("date").alias("month")), "month", "k")
    held = r.withColumn("month", F.last_day("date")).join(m, "month").select("code", (F.col("k") - 1).alias("k"))
    return m.join(held, "k").groupBy("month", "code").agg(F.count("*").alias("n"))


SIGNAL = "signal AS (SELECT a.month, a.k, a.code, a.cap, b.price / c.price - 1 AS sig FROM px_month a JOIN px_month b ON a.code = b.code AND b.k = a.k - 1 JOIN px_month c ON a.code = c.code AND c.k = a.k - 12)"


@query("J09_lagged_self_join", "SELECT k, code, sig FROM signal", SIGNAL, floats="sig")
def j09(spark, d):
    return legs.momentum(c.px_month(spark, d)).select("k", "code", "sig")


@query("J10_semi", "SELECT month, code, ret FROM px_month WHERE code IN (SELECT p_brand FROM part WHERE p_size = 50)", floats="ret", dates="month")
def j10(spark, d):
    keep = c.table(spark, d, "part").where("p_size = 50").select(F.col("p_brand").alias("code")).distinct()
    return c.px_month(spark, d).join(keep, "code", "left_semi").select("month", "code", "ret")


@query("J11_anti_worst", "SELECT month, ret FROM series_month WHERE series = 'wml' QUALIFY row_number() OVER (ORDER BY ret, month) > 5", floats="ret", dates="month")
def j11(spark, d):
    m = c.series_day(spark, d).where("series = 'wml'").groupBy(F.last_day("date").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("ret"))
    return m.join(m.orderBy("ret", "month").limit(5).select("month"), "month", "left_anti")


@query("J14_overlap", "SELECT a.k, count(*) AS kept FROM px_month a JOIN px_month b ON a.code = b.code AND b.k = a.k - 1 WHERE a.ret > 0.01 AND b.ret > 0.01 GROUP BY 1")
def j14(spark, d):
    p = c.px_month(spark, d).where("ret > 0.01").select("k", "code")
    return p.join(p.select((F.col("k") + 1).alias("k"), "code"), ["k", "code"]).groupBy("k").agg(F.count("*").alias("kept"))
