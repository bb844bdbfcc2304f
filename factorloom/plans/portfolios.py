"""Queries of legs, factors and strategies."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.operators import calendar, factors, legs, metrics, race, replication, strategy
from factorloom.plans.measures import BUCKETS, members, race_of
from factorloom.plans.registry import query
from factorloom.sources import catalog as c
from factorloom.sources import files, sections
from factorloom.sources.shared import saved

HELD = BUCKETS + """, held AS (SELECT m.k, m.code, leg, w0, d.date, di, ret FROM members m JOIN days d ON d.k = m.k + 1 LEFT JOIN ret_day r ON r.date = d.date AND r.code = m.code),
v1 AS (SELECT *, CASE WHEN ret IS NOT NULL THEN w0 * coalesce(product(1 + coalesce(ret, 0)) OVER (PARTITION BY k, leg, code ORDER BY di ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) END AS v FROM held),
leg1 AS (SELECT k, leg, date, di, sum(v * ret) / sum(v) AS ret FROM v1 GROUP BY ALL),
v2 AS (SELECT k, leg, date, di, sum(v) AS v, sum(w0) AS v0 FROM (SELECT *, w0 * product(1 + coalesce(ret, 0)) OVER (PARTITION BY k, leg, code ORDER BY di) AS v FROM held) GROUP BY ALL),
leg2 AS (SELECT k, leg, date, di, v / coalesce(lag(v) OVER (PARTITION BY k, leg ORDER BY di), v0) - 1 AS ret FROM v2),
wmlm AS (SELECT k, max(ret) FILTER (leg = 'win') AS win, max(ret) FILTER (leg = 'los') AS los, max(ret) FILTER (leg = 'win') - max(ret) FILTER (leg = 'los') AS wml FROM (SELECT k, leg, product(1 + ret) - 1 AS ret FROM leg1 WHERE ret IS NOT NULL GROUP BY ALL) GROUP BY 1)"""


def day_table(spark, d):
    return c.days(spark, d)


def held(spark, d):
    return legs.held_days(members(spark, d), c.ret_day(spark, d), day_table(spark, d))


@query("V01_leg_renormalised", "SELECT k, leg, date, ret FROM leg1", HELD, floats="ret", dates="date")
def v01(spark, d):
    return legs.leg_returns(held(spark, d)).drop("di")


@query("V02_leg_frozen", "SELECT k, leg, date, ret FROM leg2", HELD, floats="ret", dates="date")
def v02(spark, d):
    return legs.leg_returns(held(spark, d), missing="freeze").drop("di")


EVENTS = "thin AS (SELECT * FROM ret_day WHERE NOT (code < 'Brand#2' AND date > DATE '2000-06-30')), lastdi AS (SELECT code, max(di) AS di FROM thin JOIN days USING (date) GROUP BY 1), ev AS (SELECT code, di + 1 AS di FROM lastdi WHERE di < (SELECT max(di) FROM days) - 30), inj AS (SELECT x, thin.date, code, ret FROM thin, (VALUES (CAST(-0.3 AS DOUBLE)), (CAST(-1.0 AS DOUBLE))) g(x) UNION ALL SELECT x, date, ev.code, x FROM ev JOIN days USING (di), (VALUES (CAST(-0.3 AS DOUBLE)), (CAST(-1.0 AS DOUBLE))) g(x))"


@query("V03_delisting_returns", "SELECT x, code, product(1 + ret) AS wealth, count(*) AS n FROM inj GROUP BY ALL UNION ALL SELECT NULL, code, product(1 + ret), count(*) FROM thin GROUP BY ALL", EVENTS, floats="wealth", digits=4)
def v03(spark, d):
    r = c.ret_day(spark, d).where("not (code < 'Brand#2' and date > '2000-06-30')").select("date", "code", "ret")
    days = day_table(spark, d)
    parts = [legs_.withColumn("x", F.lit(x)) for x in (-0.3, -1.0) for legs_ in (factors.with_delisting(r, days, x),)]
    none = r.withColumn("x", F.lit(None).cast("double"))
    return parts[0].unionByName(parts[1]).unionByName(none).groupBy("x", "code").agg(F.product(1 + F.col("ret")).alias("wealth"), F.count("*").alias("n"))


@query("V04_missing_leg", "SELECT month, g AS flag, coalesce(ret, 0.0) AS ret FROM cal CROSS JOIN (VALUES ('A'), ('X')) v(g) LEFT JOIN (SELECT last_day(date) AS month, flag AS g, sum(ext * r) / sum(ext) AS ret FROM line GROUP BY ALL) USING (month, g)", floats="ret", dates="month")
def v04(spark, d):
    ln = c.lines(spark, d).withColumn("month", F.last_day("date"))
    grid = ln.select("month").distinct().withColumn("flag", F.explode(F.array(F.lit("A"), F.lit("X"))))
    return grid.join(ln.groupBy("month", "flag").agg(c.weighted("r", "ext").alias("ret")), ["month", "flag"], "left").select("month", "flag", F.coalesce("ret", F.lit(0.0)).alias("ret"))


@query("T01_signals", "SELECT a.k, a.code, b.price / c.price - 1 AS skip, a.price / c.price - 1 AS whole FROM px_month a JOIN px_month b ON a.code = b.code AND b.k = a.k - 1 JOIN px_month c ON a.code = c.code AND c.k = a.k - 12", floats="skip whole")
def t01(spark, d):
    p = c.px_month(spark, d)
    return legs.momentum(p).select("k", "code", F.col("sig").alias("skip")).join(legs.momentum(p, skip=0).select("k", "code", F.col("sig").alias("whole")), ["k", "code"])


@query("T02_eligibility", "SELECT month, count(*) AS n FROM elig GROUP BY 1", BUCKETS, dates="month")
def t02(spark, d):
    return legs.eligible(legs.momentum(c.px_month(spark, d)), 5).groupBy("month").agg(F.count("*").alias("n"))


@query("T03_long_short", "SELECT k, win, los, wml FROM wmlm WHERE wml IS NOT NULL", HELD, floats="win los wml")
def t03(spark, d):
    return legs.long_short(legs.leg_returns(held(spark, d)))


@query("T04_market_factor", "SELECT date, sum(pc * ret) / sum(pc) AS mkt FROM (SELECT date, ret, lag(cap) OVER (PARTITION BY code ORDER BY di) AS pc, di - lag(di) OVER (PARTITION BY code ORDER BY di) AS gap FROM ret_day JOIN days USING (date)) WHERE gap = 1 AND ret IS NOT NULL GROUP BY 1", floats="mkt", dates="date")
def t04(spark, d):
    return factors.market(c.ret_day(spark, d), day_table(spark, d))


ANNUAL = """june AS (SELECT year(month) AS year, code, cap, 1 / pbr AS bm FROM px_month WHERE month(month) = 6),
grp AS (SELECT year, code, cap AS w0, CASE WHEN cap < med THEN 'S' ELSE 'B' END || CASE WHEN bm <= p30 THEN 'L' WHEN bm >= p70 THEN 'H' ELSE 'M' END AS leg FROM june JOIN (SELECT year, quantile_cont(cap, CAST(0.5 AS DOUBLE)) AS med, quantile_cont(bm, CAST(0.3 AS DOUBLE)) AS p30, quantile_cont(bm, CAST(0.7 AS DOUBLE)) AS p70 FROM june GROUP BY 1) USING (year)),
ydays AS (SELECT date, di, CASE WHEN month(date) > 6 THEN year(date) ELSE year(date) - 1 END AS year FROM days),
aheld AS (SELECT g.*, y.date, y.di, ret FROM grp g JOIN ydays y USING (year) LEFT JOIN ret_day r ON r.date = y.date AND r.code = g.code),
av AS (SELECT *, CASE WHEN ret IS NOT NULL THEN w0 * coalesce(product(1 + coalesce(ret, 0)) OVER (PARTITION BY year, leg, code ORDER BY di ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) END AS v FROM aheld),
aleg AS (SELECT date, leg, sum(v * ret) / sum(v) AS ret FROM av GROUP BY ALL),
wide AS (SELECT date, coalesce(max(ret) FILTER (leg = 'SL'), 0) AS sl, coalesce(max(ret) FILTER (leg = 'SM'), 0) AS sm, coalesce(max(ret) FILTER (leg = 'SH'), 0) AS sh, coalesce(max(ret) FILTER (leg = 'BL'), 0) AS bl, coalesce(max(ret) FILTER (leg = 'BM'), 0) AS bmm, coalesce(max(ret) FILTER (leg = 'BH'), 0) AS bh FROM aleg GROUP BY 1)"""


@query("T05_size_value", "SELECT date, (sl + sm + sh) / 3 - (bl + bmm + bh) / 3 AS smb, (sh + bh) / 2 - (sl + bl) / 2 AS hml FROM wide", ANNUAL, floats="smb hml", dates="date")
def t05(spark, d):
    return factors.size_value(c.px_month(spark, d), c.ret_day(spark, d), day_table(spark, d))


SIX = """g6 AS (SELECT k, code, cap AS w0, CASE WHEN cap < med THEN 'S' ELSE 'B' END || CASE WHEN sig <= p30 THEN 'L' WHEN sig >= p70 THEN 'H' ELSE 'M' END AS leg FROM (SELECT *, quantile_cont(cap, CAST(0.5 AS DOUBLE)) OVER (PARTITION BY k) AS med, quantile_cont(sig, CAST(0.3 AS DOUBLE)) OVER (PARTITION BY k) AS p30, quantile_cont(sig, CAST(0.7 AS DOUBLE)) OVER (PARTITION BY k) AS p70 FROM signal)),
okk AS (SELECT k FROM g6 WHERE leg IN ('SL', 'SH', 'BL', 'BH') GROUP BY 1 HAVING count(DISTINCT leg) = 4 AND count(*) >= 8),
h6 AS (SELECT g.k, g.code, leg, w0, d.date, di, ret FROM g6 g JOIN okk USING (k) JOIN days d ON d.k = g.k + 1 LEFT JOIN ret_day r ON r.date = d.date AND r.code = g.code WHERE leg IN ('SL', 'SH', 'BL', 'BH')),
s6 AS (SELECT k, leg, date, di, sum(v) AS v, sum(w0) AS v0 FROM (SELECT *, w0 * product(1 + coalesce(ret, 0)) OVER (PARTITION BY k, leg, code ORDER BY di) AS v FROM h6) GROUP BY ALL),
l6 AS (SELECT k, leg, product(1 + ret) - 1 AS ret FROM (SELECT *, v / coalesce(lag(v) OVER (PARTITION BY k, leg ORDER BY di), v0) - 1 AS ret FROM s6) GROUP BY ALL)"""


@query("T06_size_momentum", "SELECT k, (max(ret) FILTER (leg = 'SH') + max(ret) FILTER (leg = 'BH')) / 2 - (max(ret) FILTER (leg = 'SL') + max(ret) FILTER (leg = 'BL')) / 2 AS wml FROM l6 GROUP BY 1", f"{BUCKETS}, {SIX}", floats="wml")
def t06(spark, d):
    return factors.size_momentum(legs.momentum(c.px_month(spark, d)), c.ret_day(spark, d), day_table(spark, d), least=8)


GRID = """gsig AS (SELECT a.month, a.k, a.code, a.cap, b.price / c.price - 1 AS s1, a.price / c.price - 1 AS s0 FROM px_month a JOIN px_month c ON a.code = c.code AND c.k = a.k - 12 LEFT JOIN px_month b ON a.code = b.code AND b.k = a.k - 1 WHERE a.cap > 0),
gu AS (SELECT v AS variant, month, k, code, cap, s1 AS sig FROM gsig, (VALUES ('base'), ('quintiles'), ('equal'), ('one market'), ('large'), ('no skip')) g(v) WHERE v <> 'no skip' AND s1 IS NOT NULL UNION ALL SELECT 'no skip', month, k, code, cap, s0 FROM gsig),
gw AS (SELECT *, CASE WHEN variant = 'quintiles' THEN 5 ELSE 3 END AS bins FROM gu WHERE (variant <> 'one market' OR code < 'Brand#3') QUALIFY variant <> 'large' OR cap >= quantile_cont(cap, CAST(0.5 AS DOUBLE)) OVER (PARTITION BY variant, month)),
gel AS (SELECT * FROM gw QUALIFY count(*) OVER (PARTITION BY variant, month) >= 3 * bins),
ged AS (SELECT variant, month, list_sort(list_distinct(CASE WHEN variant = 'quintiles' THEN quantile_cont(sig, [CAST(0 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.4 AS DOUBLE), CAST(0.6 AS DOUBLE), CAST(0.8 AS DOUBLE), CAST(1 AS DOUBLE)]) ELSE quantile_cont(sig, [CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) / 3, CAST(2 AS DOUBLE) / 3, CAST(1 AS DOUBLE)]) END)) AS e FROM gel GROUP BY variant, month),
gmem AS (SELECT variant, k, code, CASE WHEN bucket = last THEN 'win' ELSE 'los' END AS leg, CASE WHEN variant = 'equal' THEN 1.0 ELSE cap END AS w0 FROM (SELECT gel.*, len(list_filter(e[2:-2], lambda x: x < sig)) AS bucket, len(e) - 2 AS last FROM gel JOIN ged USING (variant, month)) WHERE bucket = last OR bucket = 0),
gheld AS (SELECT m.variant, m.k, m.code, leg, w0, d.date, di, ret FROM gmem m JOIN days d ON d.k = m.k + 1 LEFT JOIN ret_day r ON r.date = d.date AND r.code = m.code),
gsum AS (SELECT variant, k, leg, date, di, sum(v) AS v, sum(w0) AS v0 FROM (SELECT *, w0 * product(1 + coalesce(ret, 0)) OVER (PARTITION BY variant, k, leg, code ORDER BY di) AS v FROM gheld) GROUP BY ALL),
gleg AS (SELECT variant, k, leg, date, v / coalesce(lag(v) OVER (PARTITION BY variant, k, leg ORDER BY di), v0) - 1 AS ret FROM gsum),
gday AS (SELECT * FROM (SELECT variant, date, max(ret) FILTER (leg = 'win') - max(ret) FILTER (leg = 'los') AS r FROM gleg GROUP BY variant, date) WHERE r IS NOT NULL),
gmon AS (SELECT variant, k, max(x) FILTER (leg = 'win') - max(x) FILTER (leg = 'los') AS wml FROM (SELECT variant, k, leg, product(1 + ret) - 1 AS x FROM gleg GROUP BY variant, k, leg) GROUP BY variant, k),
gf AS (SELECT variant, last_day(date) AS month, arg_max(v, date) AS fvar FROM (SELECT variant, date, CASE WHEN count(*) OVER w >= 126 THEN 21 * avg(r * r) OVER w END AS v FROM gday WINDOW w AS (PARTITION BY variant ORDER BY date ROWS 125 PRECEDING)) WHERE v IS NOT NULL GROUP BY ALL),
gr AS (SELECT variant, fvar, wml, row_number() OVER (PARTITION BY variant ORDER BY month) - 1 AS t FROM gf JOIN cal USING (month) JOIN gmon USING (variant, k) WHERE month < (SELECT max(month) FROM cal))"""


GRID_BINS = {"base": 3, "quintiles": 5, "equal": 3, "one market": 3, "large": 3, "no skip": 3}


@saved("lineitem", "part")
def grid_legs(spark, d):
    """Daily legs of the six constructions: leg is `variant:win` or `variant:los`."""
    p = c.px_month(spark, d)
    skip, whole = legs.momentum(p), legs.momentum(p, skip=0)
    large = skip.join(skip.groupBy("month").agg(F.percentile("cap", 0.5).alias("_med")), "month").where("cap >= _med").drop("_med")
    signal = {"base": skip, "quintiles": skip, "equal": skip, "one market": skip.where("code < 'Brand#3'"), "large": large, "no skip": whole}
    picked = None
    for name, bins in GRID_BINS.items():
        own = legs.extremes(signal[name], bins).withColumn("leg", F.concat(F.lit(f"{name}:"), "leg"))
        own = own.withColumn("w0", F.lit(1.0)) if name == "equal" else own
        picked = own if picked is None else picked.unionByName(own)
    return legs.leg_returns(legs.held_days(picked, c.ret_day(spark, d), day_table(spark, d)), missing="freeze")


def grid_days(spark, d):
    """Daily winners minus losers of each construction: series, date, r."""
    at = lambda side: F.max(F.when(F.col("leg").endswith(f":{side}"), F.col("ret")))
    return grid_legs(spark, d).groupBy(F.substring_index("leg", ":", 1).alias("series"), "date").agg((at("win") - at("los")).alias("r")).where("r is not null")


def grid_race(spark, d):
    """Race rows of each construction whose next return is the difference of the compounded legs."""
    m = legs.compounded(grid_legs(spark, d), "ret", "k", "leg")
    at = lambda side: F.max(F.when(F.col("leg").endswith(f":{side}"), F.col("ret")))
    wml = m.groupBy(F.substring_index("leg", ":", 1).alias("series"), "k").agg((at("win") - at("los")).alias("ret_next"))
    x = race.race(grid_days(spark, d)).drop("ret_next", "t").join(c.months(spark, d), "month").join(wml, ["series", "k"]).where("ret_next is not null")
    return x.withColumn("t", F.row_number().over(W.partitionBy("series").orderBy("month")) - 1)


@query("T07_construction_grid", "SELECT variant, s AS strategy, sqrt(12) * avg(x) / stddev_samp(x) AS sharpe, min(x) * 100 AS worst, count(*) AS n FROM (SELECT variant, 'RAW' AS s, wml AS x FROM gr WHERE t >= 36 UNION ALL SELECT variant, 'RW126', (0.12 / sqrt(12)) / sqrt(fvar) * wml FROM gr WHERE t >= 36) GROUP BY ALL", GRID, floats="sharpe worst", digits=5)
def t07(spark, d):
    """Six constructions, plain and managed by the 126-day variance. With 25 names the base has three groups."""
    x = grid_race(spark, d).where(F.col("t") >= race.FIRST).select(F.col("series").alias("variant"), F.col("ret_next").alias("RAW"), (race.leverage("fvar") * F.col("ret_next")).alias("RW126"))
    return x.unpivot("variant", ["RAW", "RW126"], "strategy", "x").groupBy("variant", "strategy").agg(metrics.sharpe("x").alias("sharpe"), (F.min("x") * 100).alias("worst"), F.count("*").alias("n"))


@saved("lineitem", "part")
def baselines(spark, d):
    return race.baselines(race_of(spark, d))


def baseline_race(spark, d):
    """The race's rows and the forecasts that SQL can repeat: expanding mean, 126-day variance, tuned recursion."""
    return race_of(spark, d), baselines(spark, d)


def strats(spark, d, of=baseline_race):
    return race.strategies(*of(spark, d))


@query("T08_vol_target", "SELECT series, model, count(*) AS n, avg(r) * 12 AS mean, sqrt(12) * avg(r) / stddev_samp(r) AS sharpe, min(r) AS worst FROM strat GROUP BY ALL", floats="mean sharpe worst")
def t08(spark, d):
    return strats(spark, d).groupBy("series", "model").agg(F.count("*").alias("n"), (F.avg("r") * 12).alias("mean"), metrics.sharpe("r").alias("sharpe"), F.min("r").alias("worst"))


@query("T09_dynamic_leverage", "SELECT series, t, least(greatest(mu / (5 * fvar), 0), 2) * ret_next AS r FROM (SELECT *, avg(ret_next) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mu FROM race) WHERE t >= 36", floats="r")
def t09(spark, d):
    return strategy.dynamic(race_of(spark, d), 5, 0, 2).where("t >= 36").select("series", "t", "r")


@query("T10_downside_scaling", "SELECT r.series, t, (0.12 / sqrt(12)) / sqrt(2 * down) * ret_next AS r FROM race r JOIN series_month m ON r.series = m.series AND r.month = m.month WHERE down > 0", floats="r")
def t10(spark, d):
    return race_of(spark, d).where("down > 0").select("series", "t", (race.leverage(2 * F.col("down")) * F.col("ret_next")).alias("r"))


@query("T11_turnover", "SELECT a.k, a.leg, 1 - count(b.code) / count(*) AS turnover FROM members a LEFT JOIN members b ON a.code = b.code AND a.leg = b.leg AND b.k = a.k - 1 WHERE a.k > (SELECT min(k) FROM members) GROUP BY ALL", BUCKETS, floats="turnover")
def t11(spark, d):
    return legs.turnover(members(spark, d))


@query("T12_cost_sweep", "SELECT series, model, bp, sqrt(12) * avg(net) / stddev_samp(net) AS sharpe FROM (SELECT series, model, bp, r - bp / 10000.0 * 2 * abs(lev - coalesce(lag(lev) OVER (PARTITION BY series, model, bp ORDER BY t), lev)) - 0.01 / 12 * lev AS net FROM strat, (VALUES (0), (10), (30), (60), (100)) g(bp)) GROUP BY ALL", floats="sharpe")
def t12(spark, d):
    return strategy.costs(strats(spark, d), [0, 10, 30, 60, 100], borrow=0.01).groupBy("series", "model", "bp").agg(metrics.sharpe("net").alias("sharpe"))


@query("T12b_full_cost", "SELECT series, model, bp, sqrt(12) * avg(net) / stddev_samp(net) AS sharpe FROM (SELECT series, model, bp, r - bp / 10000.0 * (2 * (SELECT avg(turnover) FROM (SELECT 1 - count(b.code) / count(*) AS turnover FROM members a LEFT JOIN members b ON a.code = b.code AND a.leg = b.leg AND b.k = a.k - 1 WHERE a.k > (SELECT min(k) FROM members) GROUP BY a.k, a.leg)) * lev + 2 * abs(lev - coalesce(lag(lev) OVER (PARTITION BY series, model, bp ORDER BY t), lev))) AS net FROM strat, (VALUES (0), (30), (60), (100)) g(bp)) GROUP BY ALL", BUCKETS, floats="sharpe")
def t12b(spark, d):
    """Net of trading the factor's own turnover, in proportion to leverage, beside the changes of leverage."""
    turnover = legs.turnover(members(spark, d)).agg(F.avg("turnover").alias("to"))
    net = strategy.costs(strats(spark, d), [0, 30, 60, 100]).join(F.broadcast(turnover)).withColumn("net", F.col("net") - F.col("bp") / 10000 * 2 * F.col("to") * F.col("lev"))
    return net.groupBy("series", "model", "bp").agg(metrics.sharpe("net").alias("sharpe"))


@query("T13b_borrow_grid", "SELECT series, model, min(f) FILTER (gain <= 0) AS breakeven FROM (SELECT a.series, a.model, a.f, round(a.es - b.es, 9) AS gain FROM bes a JOIN bes b USING (series, f) WHERE b.model = 'RW126' AND a.model <> 'RW126') GROUP BY ALL", "bes AS (SELECT series, model, f, avg(net) AS es FROM (SELECT series, model, f, net, row_number() OVER (PARTITION BY series, model, f ORDER BY net) AS rn, count(*) OVER (PARTITION BY series, model, f) AS n FROM (SELECT series, model, f, r - f / 12 * lev AS net FROM strat, (SELECT unnest(range(201)) * CAST(0.1 AS DOUBLE) / 200 AS f))) WHERE rn <= greatest(1, floor(CAST(0.05 AS DOUBLE) * n)) GROUP BY ALL)", floats="breakeven", digits=5)
def t13b(spark, d):
    """The first borrowing rate of a grid at which the tail gain over the random walk is gone."""
    each = strats(spark, d).withColumn("f", F.explode(F.expr("transform(sequence(0, 200), i -> i * double(0.1) / 200)"))).withColumn("net", F.col("r") - F.col("f") / 12 * F.col("lev"))
    tail = metrics.expected_shortfall(each, "net", ["series", "model", "f"]).withColumn("es", F.col("es") / 100)
    base = tail.where("model = 'RW126'").select("series", "f", F.col("es").alias("_b"))
    gap = tail.where("model != 'RW126'").join(base, ["series", "f"]).withColumn("gain", F.round(F.col("es") - F.col("_b"), 9))
    return gap.groupBy("series", "model").agg(F.min(F.when(F.col("gain") <= 0, F.col("f"))).alias("breakeven"))


@query("T13_breakeven", "SELECT series, model, min(CASE WHEN gap >= 0 AND nxt < 0 THEN bp + (nb - bp) * gap / (gap - nxt) END) AS breakeven FROM (SELECT *, lead(gap) OVER w AS nxt, lead(bp) OVER w AS nb FROM (SELECT a.series, a.model, a.bp, a.m - p.m AS gap FROM (SELECT series, model, bp, avg(net) / stddev_samp(net) AS m FROM (SELECT series, model, bp, r - bp / 10000.0 * 2 * abs(lev - coalesce(lag(lev) OVER (PARTITION BY series, model, bp ORDER BY t), lev)) AS net FROM strat, (VALUES (0), (10), (30), (60), (100)) g(bp)) GROUP BY ALL) a JOIN (SELECT series, avg(r) / stddev_samp(r) AS m FROM strat WHERE model = 'plain' GROUP BY 1) p ON a.series = p.series WHERE a.model <> 'plain') WINDOW w AS (PARTITION BY series, model ORDER BY bp)) GROUP BY ALL", floats="breakeven", digits=4)
def t13(spark, d):
    return strategy.breakeven(strats(spark, d), [0, 10, 30, 60, 100])


@query("T15_window_sweep", "SELECT series, w, sqrt(12) * avg(x) / stddev_samp(x) AS sharpe, count(*) AS n FROM (SELECT m.series, w, (0.12 / sqrt(12)) / sqrt(v) * lead(ret) OVER (PARTITION BY m.series, w ORDER BY m.month) AS x FROM series_month m JOIN (SELECT series, w, last_day(date) AS month, arg_max(v, date) AS v FROM (SELECT series, date, 21 AS w, CASE WHEN count(*) OVER a >= 21 THEN 21 * avg(r * r) OVER a END AS v FROM series_day WINDOW a AS (PARTITION BY series ORDER BY date ROWS 20 PRECEDING) UNION ALL SELECT series, date, 63, CASE WHEN count(*) OVER a >= 63 THEN 21 * avg(r * r) OVER a END FROM series_day WINDOW a AS (PARTITION BY series ORDER BY date ROWS 62 PRECEDING)) WHERE v IS NOT NULL GROUP BY ALL) f ON m.series = f.series AND m.month = f.month) WHERE x IS NOT NULL GROUP BY ALL", floats="sharpe")
def t15(spark, d):
    s = c.series_day(spark, d)
    parts = [race.race(s, w).select("series", F.lit(w).alias("w"), (race.leverage("fvar") * F.col("ret_next")).alias("x")) for w in (21, 63)]
    return parts[0].unionByName(parts[1]).groupBy("series", "w").agg(metrics.sharpe("x").alias("sharpe"), F.count("*").alias("n"))


@query("T16_target_invariance", "SELECT series, model, tv, sqrt(12) * avg(tv / 0.12 * r) / stddev_samp(tv / 0.12 * r) AS sharpe FROM strat, (VALUES (CAST(0.08 AS DOUBLE)), (CAST(0.12 AS DOUBLE)), (CAST(0.2 AS DOUBLE))) g(tv) GROUP BY ALL", floats="sharpe")
def t16(spark, d):
    each = strats(spark, d).withColumn("tv", F.explode(F.array(F.lit(0.08), F.lit(0.12), F.lit(0.2))))
    return each.groupBy("series", "model", "tv").agg(metrics.sharpe(F.col("tv") / 0.12 * F.col("r")).alias("sharpe"))


@query("T17_excess_returns", "SELECT series, sqrt(12) * avg(ret - rf) / stddev_samp(ret - rf) AS sharpe, avg(ret - rf) / (stddev_samp(ret - rf) / sqrt(count(*))) AS t FROM series_month JOIN rf_month USING (month) GROUP BY 1", floats="sharpe t")
def t17(spark, d):
    x = race.months(c.series_day(spark, d)).join(c.rf_month(spark, d), "month").withColumn("x", F.col("ret") - F.col("rf"))
    return x.groupBy("series").agg(metrics.sharpe("x").alias("sharpe"), metrics.mean_t("x").alias("t"))


@query("T17b_other_rate", "SELECT series, rate, sqrt(12) * avg(ret - rf) / stddev_samp(ret - rf) AS sharpe FROM series_month JOIN (SELECT month, 'mean' AS rate, rf FROM rf_month UNION ALL SELECT last_day(CAST(o_orderdate AS DATE)), 'median', quantile_cont(o_totalprice, CAST(0.5 AS DOUBLE)) / 1e8 FROM orders GROUP BY 1) USING (month) GROUP BY ALL", floats="sharpe")
def t17b(spark, d):
    """Excess returns over two risk-free rates."""
    month = F.last_day(F.to_date("o_orderdate")).alias("month")
    other = c.table(spark, d, "orders").groupBy(month).agg((F.percentile("o_totalprice", 0.5) / 1e8).alias("rf")).withColumn("rate", F.lit("median"))
    rates = c.rf_month(spark, d).withColumn("rate", F.lit("mean")).unionByName(other)
    x = race.months(c.series_day(spark, d)).join(rates, "month").withColumn("x", F.col("ret") - F.col("rf"))
    return x.groupBy("series", "rate").agg(metrics.sharpe("x").alias("sharpe"))


@query("T18_crash_timing", "SELECT s.series, s.model, count(*) AS n, avg(lev) AS lev FROM strat s JOIN race r ON s.series = r.series AND s.t = r.t WHERE ret_next < -0.02 AND model <> 'plain' GROUP BY ALL", floats="lev")
def t18(spark, d):
    r = race_of(spark, d)
    s = race.strategies(r, baselines(spark, d)).where("model != 'plain'")
    return s.join(r.where("ret_next < -0.02").select("series", "t"), ["series", "t"], "left_semi").groupBy("series", "model").agg(F.count("*").alias("n"), F.avg("lev").alias("lev"))


@query("P09_leverage_cap", "SELECT series, model, cap, sqrt(12) * avg(least(lev, cap) / lev * r) / stddev_samp(least(lev, cap) / lev * r) AS sharpe FROM strat, (VALUES (CAST(1.5 AS DOUBLE)), (CAST(2 AS DOUBLE)), (CAST(3 AS DOUBLE))) g(cap) GROUP BY ALL", floats="sharpe")
def p09(spark, d):
    return strategy.capped(strats(spark, d), [1.5, 2.0, 3.0]).groupBy("series", "model", "cap").agg(metrics.sharpe("x").alias("sharpe"))


@query("T19_decile_file", "SELECT month, ret FROM series_month WHERE series = 'wml'", floats="ret", dates="month")
def t19(spark, d):
    f = c.factor_day(spark, d).where("wml is not null").select("date", "los", "win")
    back = files.sectioned(files.write_sectioned(f.select("date", F.col("los").alias("d1"), F.col("win").alias("d10")), "Decile Returns -- Daily"), "Decile Returns -- Daily", ["d1", "d10"])
    day = back.groupBy("date").agg((F.max(F.when(F.col("name") == "d10", F.col("value"))) - F.max(F.when(F.col("name") == "d1", F.col("value")))).alias("r"))
    return day.groupBy(F.last_day("date").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("ret"))



@saved("lineitem", "part")
def decile_day(spark, d):
    """Value-weighted daily returns of ten groups of parts by size, d1 to d10, in columns: date, d1 .. d10."""
    size = c.table(spark, d, "part").select("p_partkey", (F.floor((F.col("p_size") - 1) / 5) + 1).alias("q"))
    li = c.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_partkey").alias("p_partkey"), F.col("l_extendedprice").alias("ext"), (F.col("l_discount") - F.col("l_tax")).alias("r"))
    return li.join(size, "p_partkey").groupBy("date").agg(*(c.weighted("r", "ext", F.col("q") == q).alias(f"d{q}") for q in range(1, 11)))


DECILES = [f"d{q}" for q in range(1, 11)]
DAILY, MONTHLY = "Value Weight Returns -- Daily", "Value Weight Returns -- Monthly"


def decile_library(spark, d):
    """Ten deciles written as a library of text files, one a year, with a daily and a monthly section each; gives the folder."""
    day = decile_day(spark, d)
    month = day.groupBy(F.last_day("date").alias("date")).agg(*((F.product(1 + F.col(q)) - 1).alias(q) for q in DECILES))
    part = lambda df, title, digits: df.select(F.year("date").alias("year"), F.lit(title).alias("section"), "date", F.lit(digits).alias("digits"), *DECILES)
    other = part(month, "Equal Weight Returns -- Monthly", 6)
    return sections.write(part(day, DAILY, 8).unionByName(part(month, MONTHLY, 6)).unionByName(other), "year", "section", "date", "digits", DECILES)


def spread(spark, path, title):
    """The last decile less the first of a section, where both have a value: series, date, r."""
    x = sections.read(spark, [path], title, DECILES).where(F.col("name").isin("d1", "d10"))
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    return x.groupBy("date").agg((of("d10") - of("d1")).alias("r")).where("r is not null").select(F.lit("d10-d1").alias("series"), "date", "r")


DEC = """dec AS (SELECT CAST(l_shipdate AS DATE) AS date, (p_size - 1) // 5 + 1 AS q, sum(l_extendedprice * (l_discount - l_tax)) / sum(l_extendedprice) AS ret FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
dday AS (SELECT a.date, a.ret - b.ret AS r FROM dec a JOIN dec b ON a.date = b.date AND a.q = 10 AND b.q = 1),
dmon AS (SELECT month, max(ret) FILTER (q = 10) - max(ret) FILTER (q = 1) AS r FROM (SELECT last_day(date) AS month, q, product(1 + ret) - 1 AS ret FROM dec GROUP BY ALL) GROUP BY 1),
dvar AS (SELECT last_day(CAST(month + INTERVAL 1 DAY AS DATE)) AS month, v FROM (SELECT last_day(date) AS month, arg_max(v, date) AS v FROM (SELECT date, CASE WHEN count(*) OVER w >= 126 THEN 21 * avg(r * r) OVER w END AS v FROM dday WINDOW w AS (ORDER BY date ROWS 125 PRECEDING)) WHERE v IS NOT NULL GROUP BY 1)),
dstar AS (SELECT month, r, (0.12 / sqrt(12)) / sqrt(v) * r AS s FROM dmon LEFT JOIN dvar USING (month) WHERE r IS NOT NULL),
dsam AS (SELECT 'all' AS sample, * FROM dstar UNION ALL SELECT 'to 1998', * FROM dstar WHERE year(month) <= 1998),
dgap AS (SELECT *, avg(r) OVER p AS rm, avg(s) OVER p AS sm, s / stddev_samp(s) OVER p - r / stddev_samp(r) OVER p AS gap, row_number() OVER (PARTITION BY sample ORDER BY r, month) AS k FROM dsam WINDOW p AS (PARTITION BY sample)),
dout AS (SELECT 'd10-d1' AS series, sample, count(*) AS n, avg(r) * 1200 AS mean, sqrt(12) * avg(r) / stddev_pop(r) AS sharpe, avg(pow(r - rm, 3)) / pow(var_pop(r), 1.5) AS skew, avg(pow(r - rm, 4)) / pow(var_pop(r), 2) - 3 AS kurtosis, min(r) * 100 AS worst, max(r) FILTER (k = 2) * 100 AS second_worst,
  sqrt(12) * avg(s) / stddev_pop(s) AS managed_sharpe, avg(pow(s - sm, 3)) / pow(var_pop(s), 1.5) AS managed_skew, avg(pow(s - sm, 4)) / pow(var_pop(s), 2) - 3 AS managed_kurtosis, min(s) * 100 AS managed_worst, sqrt(12) * avg(gap) / stddev_pop(gap) AS information_ratio FROM dgap GROUP BY sample)"""


@query("T19b_replication_gate", "SELECT *, coalesce(sharpe > 0.35 AND sharpe < 0.65 AND skew < -1 AND managed_sharpe > 1.3 * sharpe AND worst < -50, false) AS passes FROM dout", DEC, floats="mean sharpe skew kurtosis worst second_worst managed_sharpe managed_skew managed_kurtosis managed_worst information_ratio", digits=4)
def t19b(spark, d):
    """Ten deciles from library files, their spread plain and managed, and the gate of the published figures."""
    path = decile_library(spark, d)
    daily, monthly = spread(spark, path, DAILY), spread(spark, path, MONTHLY).withColumnRenamed("date", "month")
    return replication.gate(replication.managed(monthly, daily), {"all": F.lit(True), "to 1998": F.year("month") <= 1998})


#: Windows of months over which leverage is averaged, as (name, first month, last month).
WINDOWS = [("1999 to 2000", "1999-06-30", "2000-06-30"), ("2000 to 2001", "2000-07-31", "2001-06-30")]


@query("T18b_crisis_windows", "SELECT s.series, s.model, 'before falls' AS span, count(*) AS n, avg(lev) AS lev, median(lev) AS middle FROM strat s JOIN race r ON s.series = r.series AND s.t = r.t WHERE r.ret_next < -0.02 AND model <> 'plain' GROUP BY ALL UNION ALL SELECT series, model, w, count(*), avg(lev), median(lev) FROM strat JOIN (VALUES ('1999 to 2000', DATE '1999-06-30', DATE '2000-06-30'), ('2000 to 2001', DATE '2000-07-31', DATE '2001-06-30')) v(w, a, b) ON month BETWEEN a AND b WHERE model <> 'plain' GROUP BY ALL", floats="lev middle")
def t18b(spark, d):
    """Mean and median leverage just before falls and in windows of months."""
    r = race_of(spark, d)
    return strategy.timing(race.strategies(r, baselines(spark, d)), r, fall=-0.02, windows=WINDOWS)
