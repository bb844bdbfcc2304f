"""Queries of forecast evaluation, bootstrap and tail inference."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.operators import bootstrap as bs
from factorloom.operators import inference as inf
from factorloom.operators import factors, forecast, metrics, race, regression, rolling, tails
from factorloom.plans.measures import BEAR, bears, months
from factorloom.plans.forecasting import whole_race
from factorloom.plans.portfolios import ANNUAL, baseline_race, strats
from factorloom.plans.registry import query
from factorloom.sources import catalog as c
from factorloom.sources.shared import saved

#: Replicates of the bootstraps, and of the Pareto tails.
REPS = 5000
TAIL_REPS = 2000
#: Exceedances that a replicate's tail needs: 15 % of the 30 to 48 months that the tables' calendar leaves.
LEAST_EXCEEDANCES = 4


def scored(spark, d, of=baseline_race):
    return race.scored(*of(spark, d))


@query("K01_leaderboard", "SELECT series, model, avg(loss) AS qlike, sqrt(avg(pow((sqrt(12 * f) - sqrt(12 * y)) * 100, 2))) AS rmse_vol, (1 - sum(pow(y - f, 2)) / any_value(b)) * 100 AS oos_r2, count(*) AS n FROM scored JOIN (SELECT series, sum(pow(y - f, 2)) AS b FROM scored WHERE model = 'ExpandingMean' GROUP BY 1) USING (series) GROUP BY ALL", floats="qlike rmse_vol oos_r2")
def k01(spark, d, of=baseline_race):
    return inf.leaderboard(scored(spark, d, of))


GAPS = "gaps AS (SELECT s.series, s.model, s.t, s.loss - b.loss AS d, pow(s.y - b.f, 2) - (pow(s.y - s.f, 2) - pow(b.f - s.f, 2)) AS adj FROM scored s JOIN scored b ON s.series = b.series AND s.t = b.t WHERE b.model = 'RW126' AND s.model <> 'RW126')"


@query("K02_diebold_mariano", "SELECT series, model, avg(d) / sqrt((var_pop(d) + 2 * (0.75 * covar_samp(d, l1) + 0.5 * covar_samp(d, l2) + 0.25 * covar_samp(d, l3))) / count(*)) AS stat FROM (SELECT *, lag(d, 1) OVER w AS l1, lag(d, 2) OVER w AS l2, lag(d, 3) OVER w AS l3 FROM gaps WINDOW w AS (PARTITION BY series, model ORDER BY t)) GROUP BY ALL", GAPS, floats="stat", digits=5)
def k02(spark, d, of=baseline_race):
    return inf.diebold_mariano(inf.loss_gaps(scored(spark, d, of)))


@query("K03_clark_west", "SELECT series, model, avg(adj) / (stddev_pop(adj) / sqrt(count(*))) AS t FROM gaps GROUP BY ALL", GAPS, floats="t")
def k03(spark, d, of=baseline_race):
    return inf.clark_west(inf.loss_gaps(scored(spark, d, of)))


def hac_sql(source: str, y: str, x: str, by: str, order: str) -> str:
    lag = lambda v, k: f"lag({v}, {k}) OVER w"
    terms = [f"(e * {lag('e', k)}) AS ee{k}, {lag('x', k)} AS x{k}" for k in range(1, 4)]
    s = lambda f0, fk: "sum(" + f0 + ") + " + " + ".join(f"{2 * (1 - k / 4)} * sum({fk.format(k=k)})" for k in range(1, 4))
    return f"""fit AS (SELECT {by}, {order} AS o, {y} AS y, {x} AS x, regr_slope({y}, {x}) OVER p AS b, regr_intercept({y}, {x}) OVER p AS a FROM {source} WINDOW p AS (PARTITION BY {by})),
res AS (SELECT *, y - a - b * x AS e FROM fit), lags AS (SELECT *, {', '.join(terms)} FROM res WINDOW w AS (PARTITION BY {by} ORDER BY o)),
sums AS (SELECT {by}, any_value(a) AS a, any_value(b) AS b, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, {s('e * e', 'ee{k}')} AS s00, {s('e * e * x', 'ee{k} * (x + x{k}) / 2')} AS s01, {s('e * e * x * x', 'ee{k} * x * x{k}')} AS s11 FROM lags GROUP BY {by}),
hac AS (SELECT {by}, a, b, a / sqrt(i00 * i00 * s00 + 2 * i00 * i01 * s01 + i01 * i01 * s11) AS t_a, b / sqrt(i01 * i01 * s00 + 2 * i01 * i11 * s01 + i11 * i11 * s11) AS t_b FROM (SELECT *, sxx / (n * sxx - sx * sx) AS i00, -sx / (n * sxx - sx * sx) AS i01, n / (n * sxx - sx * sx) AS i11 FROM sums))"""


COND = GAPS + ", gb AS (SELECT g.series || '-' || g.model AS key, t, g.d, CAST(CASE WHEN race.rv > avg(race.rv) OVER (PARTITION BY g.series, g.model) THEN 1 ELSE 0 END AS DOUBLE) AS hi FROM gaps g JOIN race USING (series, t)), " + hac_sql("gb", "d", "hi", "key", "t")


@query("K04_conditional_hac", "SELECT key, a, b, t_a, t_b FROM hac", COND, floats="a b t_a t_b", digits=4)
def k04(spark, d, of=baseline_race):
    r, f = of(spark, d)
    g = inf.loss_gaps(race.scored(r, f)).join(r.select("series", "t", F.col("rv").alias("v")), ["series", "t"])
    x = F.when(F.col("v") > F.avg("v").over(W.partitionBy("series", "model")), 1.0).otherwise(0.0)
    return inf.hac_line(g.select(F.concat_ws("-", "series", "model").alias("key"), "t", "d", x.alias("hi")), "d", "hi", ["key"], "t").select("key", "a", "b", "t_a", "t_b")


RISK = "rk AS (SELECT series, month, ret * 100 AS r, v FROM (SELECT series, month, ret, lag(CASE WHEN n = 6 THEN v END) OVER (PARTITION BY series ORDER BY month) AS v FROM (SELECT series, month, ret, var_samp(ret) OVER w AS v, count(*) OVER w AS n FROM series_month WINDOW w AS (PARTITION BY series ORDER BY month ROWS 5 PRECEDING))) WHERE v IS NOT NULL), rz AS (SELECT series, month, r, (v - avg(v) OVER (PARTITION BY series)) / stddev_samp(v) OVER (PARTITION BY series) AS z FROM rk), " + hac_sql("rz", "r", "z", "series", "month")


@query("K05_risk_slope_hac", "SELECT series, a, b, t_a, t_b FROM hac", RISK, floats="a b t_a t_b", digits=4)
def k05(spark, d):
    o = W.partitionBy("series").orderBy("month")
    m = months(spark, d).withColumn("v", rolling.full(F.var_samp("ret"), "ret", rolling.trailing(["series"], "month", 6), 6))
    m = m.withColumn("v", F.lag("v").over(o)).where("v is not null")
    p = W.partitionBy("series")
    z = (F.col("v") - F.avg("v").over(p)) / F.stddev_samp("v").over(p)
    return inf.hac_line(m.select("series", "month", (F.col("ret") * 100).alias("r"), z.alias("z")), "r", "z", ["series"], "month")


K06 = f"""{BEAR}, own AS (SELECT series, bear, rv, lead(bears.ret) OVER (PARTITION BY series ORDER BY month) AS y FROM bears JOIN (SELECT series, month, rv FROM series_month) USING (series, month)),
side AS (SELECT series, bear, count(*) AS n, regr_slope(y, rv) AS b, regr_intercept(y, rv) AS a, regr_sxx(y, rv) AS sxx, avg(rv) AS m, regr_syy(y, rv) - pow(regr_sxy(y, rv), 2) / regr_sxx(y, rv) AS sse FROM own WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
two AS (SELECT coalesce(g.series, h.series) AS series, g.n + h.n AS n, g.a AS a0, g.b AS b0, h.a - g.a AS a1, h.b - g.b AS b1, (g.sse + h.sse) / (g.n + h.n - 4) AS s2, 1.0 / g.n + g.m * g.m / g.sxx AS va, 1.0 / g.sxx AS vb, 1.0 / h.n + h.m * h.m / h.sxx AS wa, 1.0 / h.sxx AS wb FROM (SELECT * FROM side WHERE bear = 0) g FULL JOIN (SELECT * FROM side WHERE bear = 1) h ON g.series = h.series),
terms AS (SELECT series, 'const' AS term, a0 AS beta, a0 / sqrt(s2 * va) AS t, a1 FROM two UNION ALL SELECT series, 'rv', b0, b0 / sqrt(s2 * vb), a1 FROM two UNION ALL SELECT series, 'bear', a1, a1 / sqrt(s2 * (va + wa)), a1 FROM two UNION ALL SELECT series, 'rv_bear', b1, b1 / sqrt(s2 * (vb + wb)), a1 FROM two)"""


@query("K06_interaction", "SELECT series, term, CASE WHEN a1 IS NOT NULL THEN beta END AS beta, CASE WHEN a1 IS NOT NULL THEN t END AS t FROM terms", K06, floats="beta t", digits=4)
def k06(spark, d):
    """Next month's return on variance, bear market and both; without bear months there are no coefficients."""
    nxt = bears(spark, d).withColumn("y", F.lead("ret").over(W.partitionBy("series").orderBy("month"))).where("y is not null")
    x = {"rv": F.col("rv"), "bear": F.col("bear"), "rv_bear": F.col("rv") * F.col("bear")}
    return regression.least_squares(nxt, F.col("y"), x, ["series"]).drop("n")


@query("K07_sharpe_gap", "SELECT key, (s1 - s0) / sqrt((2 - 2 * rho + 0.5 * (s1 * s1 + s0 * s0 - 2 * s1 * s0 * rho * rho)) / n) AS z FROM (SELECT a.series || '-' || a.model AS key, count(*) AS n, avg(a.r) / stddev_pop(a.r) AS s1, avg(b.r) / stddev_pop(b.r) AS s0, corr(a.r, b.r) AS rho FROM strat a JOIN strat b ON a.series = b.series AND a.t = b.t WHERE b.model = 'RW126' AND a.model <> 'RW126' GROUP BY 1)", floats="z", digits=5)
def k07(spark, d, of=baseline_race):
    s = strats(spark, d, of)
    b = s.where("model = 'RW126'").select("series", "t", F.col("r").alias("r0"))
    j = s.where("model != 'RW126'").join(b, ["series", "t"]).withColumn("key", F.concat_ws("-", "series", "model"))
    return inf.sharpe_gap_z(j, "r", "r0", ["key"])


IDX = """sizes AS (SELECT series, max(t) - 36 + 1 AS n FROM strat GROUP BY 1),
idx AS (SELECT series, b, j * 12 + o AS pos, (start + o) % n AS i FROM (SELECT series, n, b, j, CAST('0x' || substr(md5('42-' || b || '-' || j), 1, 8) AS BIGINT) % n AS start FROM sizes, (SELECT unnest(range(5000)) AS b), (SELECT unnest(range(60)) AS j) WHERE j < ceil(n / 12.0)), (SELECT unnest(range(12)) AS o) WHERE j * 12 + o < n),
samp AS (SELECT x.series, x.b, s.model, s.r FROM idx x JOIN strat s ON x.series = s.series AND s.t - 36 = x.i)"""


@query("K08_block_index", "SELECT series, b, pos, i FROM idx", IDX)
def k08(spark, d):
    n = strats(spark, d).groupBy("series").agg((F.max("t") - race.FIRST + 1).alias("n"))
    return bs.block_index(n, REPS)


@query("K08b_block_lengths", "SELECT series, block, b, count(*) AS n, CAST(sum(i) AS BIGINT) AS total FROM (SELECT series, block, b, (start + o) % n AS i FROM (SELECT series, n, block, b, j, CAST('0x' || substr(md5('42-' || b || '-' || j), 1, 8) AS BIGINT) % n AS start FROM sizes, (SELECT unnest([6, 12, 24]) AS block), (SELECT unnest(range(5000)) AS b), (SELECT unnest(range(60)) AS j) WHERE j < ceil(n / CAST(block AS DOUBLE))), (SELECT unnest(range(24)) AS o) WHERE o < block AND j * block + o < n) GROUP BY ALL", "sizes AS (SELECT series, max(t) - 36 + 1 AS n FROM strat GROUP BY 1)")
def k08b(spark, d):
    """Sizes and sums of the drawn rows of every replicate, for three lengths of a block."""
    n = strats(spark, d).groupBy("series").agg((F.max("t") - race.FIRST + 1).alias("n"))
    each = [bs.block_index(n, REPS, block).withColumn("block", F.lit(block)) for block in (6, 12, 24)]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("series", "block", "b").agg(F.count("*").alias("n"), F.sum("i").cast("long").alias("total"))


def sample(spark, d, of=baseline_race):
    return bs.resampled(strats(spark, d, of), REPS, race.FIRST)


SH = IDX + ", rs AS (SELECT series, b, model, sqrt(12) * avg(r) / stddev_pop(r) AS v FROM samp GROUP BY ALL), df AS (SELECT a.series, a.model, a.b, a.v - z.v AS d FROM rs a JOIN rs z ON a.series = z.series AND a.b = z.b WHERE z.model = 'RW126' AND a.model <> 'RW126')"
SUMMARY = "SELECT series, model, avg(d) AS boot_mean, quantile_cont(d, CAST(0.025 AS DOUBLE)) AS ci_lo, quantile_cont(d, CAST(0.975 AS DOUBLE)) AS ci_hi, avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END) AS p_le0 FROM df GROUP BY ALL"


@saved("lineitem", "part")
def _baseline_stats(spark, d):
    return bs.statistics(bs.drawn(strats(spark, d), REPS, race.FIRST))


@saved("lineitem", "part")
def _whole_stats(spark, d):
    return bs.statistics(bs.drawn(strats(spark, d, whole_race), REPS, race.FIRST))


def stats(spark, d, of=baseline_race):
    """Statistics of every replicate, from one resample that is written once; all their queries read it."""
    return (_baseline_stats if of is baseline_race else _whole_stats)(spark, d)


def summary(table, value):
    gaps = bs.against(table, value, "RW126", ["series", "b"]).where("d is not null")
    return bs.interval(gaps, ["series", "model"])


@query("K09_sharpe_bootstrap", SUMMARY, SH, floats="boot_mean ci_lo ci_hi p_le0", digits=5)
def k09(spark, d, of=baseline_race):
    return summary(stats(spark, d, of), "sharpe")


ES = IDX + ", rs AS (SELECT series, b, model, avg(r) * 100 AS v FROM (SELECT *, row_number() OVER (PARTITION BY series, b, model ORDER BY r) AS rn, count(*) OVER (PARTITION BY series, b, model) AS n FROM samp) WHERE rn <= greatest(1, floor(CAST(0.05 AS DOUBLE) * n)) GROUP BY ALL), df AS (SELECT a.series, a.model, a.b, a.v - z.v AS d FROM rs a JOIN rs z ON a.series = z.series AND a.b = z.b WHERE z.model = 'RW126' AND a.model <> 'RW126')"
OBS = "ob AS (SELECT series, model, avg(r) * 100 AS v FROM (SELECT *, row_number() OVER (PARTITION BY series, model ORDER BY r) AS rn, count(*) OVER (PARTITION BY series, model) AS n FROM strat) WHERE rn <= greatest(1, floor(CAST(0.05 AS DOUBLE) * n)) GROUP BY ALL), obs AS (SELECT a.series, a.model, a.v - z.v AS obs FROM ob a JOIN ob z ON a.series = z.series WHERE z.model = 'RW126' AND a.model <> 'RW126')"


def shortfall_gaps(table):
    return bs.against(table, "es", "RW126", ["series", "b"]).select("series", "b", "model", "d")


def es_gaps(spark, d, of=baseline_race):
    """Gap of each replicate's shortfall to the random walk's."""
    return shortfall_gaps(stats(spark, d, of))


def es_seen(spark, d, of=baseline_race):
    return bs.against(bs.shortfall(strats(spark, d, of), ["series", "model"]), "es", "RW126", ["series"]).select("series", "model", F.col("d").alias("obs"))


@query("K10_tail_bootstrap", SUMMARY, ES, floats="boot_mean ci_lo ci_hi p_le0", digits=5)
def k10(spark, d, of=baseline_race):
    return bs.interval(es_gaps(spark, d, of), ["series", "model"])


TAIL = IDX + ", rs AS (SELECT series, b, model, (avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * pow(avg(r), 3)) / pow(var_pop(r), 1.5) AS skew, min(r) * 100 AS worst, list_avg(list_sort(list(r))[1:greatest(1, CAST(floor(CAST(0.05 AS DOUBLE) * count(*)) AS INTEGER))]) * 100 AS es FROM samp GROUP BY ALL), tall AS (UNPIVOT rs ON skew, worst, es INTO NAME stat VALUE v), df AS (SELECT a.series, a.model, a.stat, a.b, a.v - z.v AS d FROM tall a JOIN tall z ON a.series = z.series AND a.b = z.b AND a.stat = z.stat WHERE z.model = 'RW126' AND a.model <> 'RW126')"


@query("K10b_tail_statistics", "SELECT series, model, stat, avg(d) AS boot_mean, quantile_cont(d, CAST(0.025 AS DOUBLE)) AS ci_lo, quantile_cont(d, CAST(0.975 AS DOUBLE)) AS ci_hi, avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END) AS p_le0 FROM df GROUP BY ALL", TAIL, floats="boot_mean ci_lo ci_hi p_le0", digits=4)
def k10b(spark, d, of=baseline_race):
    """Gaps of skewness, worst month and shortfall to the random walk's over the same replicates."""
    tall = stats(spark, d, of).unpivot(["series", "b", "model"], ["skew", "worst", "es"], "stat", "v")
    return bs.interval(bs.against(tall, "v", "RW126", ["series", "b", "stat"]).where("d is not null"), ["series", "model", "stat"])


@query("K11_certainty_bootstrap", SUMMARY, SH.replace("sqrt(12) * avg(r) / stddev_pop(r) AS v", "(avg(r) - 2.5 * var_pop(r)) * 1200 AS v"), floats="boot_mean ci_lo ci_hi p_le0", digits=5)
def k11(spark, d, of=baseline_race):
    return summary(stats(spark, d, of), "mv")


@query("K11b_power_utility_bootstrap", SUMMARY.replace("FROM df", "FROM df WHERE d IS NOT NULL"), SH.replace("sqrt(12) * avg(r) / stddev_pop(r) AS v", "CASE WHEN min(1 + r) > 0 THEN (pow(pow(avg(pow(1 + r, -9)), 1 / (1 - 10.0)), 12) - 1) * 100 END AS v"), floats="boot_mean ci_lo ci_hi p_le0", digits=4)
def k11b(spark, d, of=baseline_race):
    """The same by power utility; replicates in which a strategy loses all have no equivalent."""
    return summary(stats(spark, d, of), "crra")


@query("K12_family_max", "SELECT series, avg(CASE WHEN m >= top THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT series, b, max(c) AS m FROM (SELECT series, b, d - avg(d) OVER (PARTITION BY series, model) AS c FROM df) GROUP BY ALL) JOIN (SELECT series, max(obs) AS top FROM obs GROUP BY 1) USING (series) GROUP BY 1", f"{ES}, {OBS}", floats="p")
def k12(spark, d, of=baseline_race):
    top = es_seen(spark, d, of).groupBy("series").agg(F.max("obs").alias("top"))
    null = es_gaps(spark, d, of).withColumn("c", F.col("d") - F.avg("d").over(W.partitionBy("series", "model"))).groupBy("series", "b").agg(F.max("c").alias("m"))
    return null.join(top, "series").groupBy("series").agg(F.avg(F.expr("double(m >= top)")).alias("p"))


STEP = f"{ES}, {OBS}, sd AS (SELECT series, model, stddev_pop(d) AS sd, avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END) AS indiv_p FROM df GROUP BY ALL), seen AS (SELECT series, model, obs, sd, indiv_p, obs / sd AS t FROM obs JOIN sd USING (series, model)), nl AS (SELECT series, model, t, indiv_p, max((d - obs) / sd) OVER (PARTITION BY series, b ORDER BY t DESC, model ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM df JOIN seen USING (series, model))"


@query("K13_step_down", "SELECT series, model, t, indiv_p, max(p) OVER (PARTITION BY series ORDER BY t DESC, model) AS rw_p FROM (SELECT series, model, t, indiv_p, avg(CASE WHEN m >= t THEN 1.0 ELSE 0.0 END) AS p FROM nl GROUP BY ALL)", STEP, floats="t indiv_p rw_p", digits=5)
def k13(spark, d, of=baseline_race):
    return bs.step_down(es_gaps(spark, d, of), es_seen(spark, d, of), ["series"])


def reality(table, value, deviation):
    """Share of replicates whose largest centred t, with this deviation in it, reaches the observed largest t."""
    obs = table.groupBy("series", "model").agg(F.avg(value).alias("mean"), (F.avg(value) / (deviation(value) / F.sqrt(F.count("*")))).alias("t"))
    top = obs.groupBy("series").agg(F.max("t").alias("top"))
    each = bs.resampled(table.select("series", "model", "t", value), REPS, race.FIRST).join(obs.select("series", "model", "mean"), ["series", "model"])
    boot = each.groupBy("series", "b", "model").agg(((F.avg(value) - F.first("mean")) / (deviation(value) / F.sqrt(F.count("*")))).alias("t")).groupBy("series", "b").agg(F.max("t").alias("m"))
    return boot.join(top, "series").groupBy("series").agg(F.first("top").alias("max_t"), F.avg(F.expr("double(m >= top)")).alias("p"))


def reality_sql(value: str, deviation: str) -> str:
    return f"""{GAPS}, {IDX}, own AS (SELECT series, model, t, {value} AS x FROM gaps), ob AS (SELECT series, model, avg(x) AS mean, avg(x) / ({deviation}(x) / sqrt(count(*))) AS t FROM own GROUP BY ALL),
bt AS (SELECT i.series, i.b, o.model, (avg(x) - any_value(mean)) / ({deviation}(x) / sqrt(count(*))) AS t FROM idx i JOIN own o ON i.series = o.series AND o.t - 36 = i.i JOIN ob ON ob.series = o.series AND ob.model = o.model GROUP BY ALL)"""


REALITY = "SELECT series, any_value(top) AS max_t, avg(CASE WHEN m >= top THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT series, b, max(t) AS m FROM bt GROUP BY ALL) JOIN (SELECT series, max(t) AS top FROM ob GROUP BY 1) USING (series) GROUP BY 1"


@query("K14_reality_check", REALITY, reality_sql("-d", "stddev_pop"), floats="max_t p", digits=5)
def k14(spark, d, of=baseline_race):
    return reality(inf.loss_gaps(scored(spark, d, of)).withColumn("gain", -F.col("d")), "gain", F.stddev_pop)


@query("K14b_reality_check_adjusted", REALITY, reality_sql("adj", "stddev_samp"), floats="max_t p", digits=5)
def k14b(spark, d, of=baseline_race):
    return reality(inf.loss_gaps(scored(spark, d, of)), "adj", F.stddev_samp)


SLOPE = f"{IDX}, pt AS (SELECT i.series, i.b, s.model, sum(pow(s.y - s.f, 2)) AS sse, sqrt(12) * avg(s.lev * s.ret_next) / stddev_pop(s.lev * s.ret_next) AS sr FROM idx i JOIN scored s ON i.series = s.series AND s.t - 36 = i.i GROUP BY ALL), sl AS (SELECT a.series, a.b, regr_slope(a.sr, (1 - a.sse / e.sse) * 100) AS slope FROM pt a JOIN pt e ON a.series = e.series AND a.b = e.b WHERE e.model = 'ExpandingMean' GROUP BY ALL)"


def slopes(spark, d, of=baseline_race):
    x = bs.resampled(scored(spark, d, of), REPS, race.FIRST)
    g = x.groupBy("series", "b", "model").agg(F.sum(F.pow(F.col("y") - F.col("f"), F.lit(2))).alias("sse"), bs.sharpe_pop(F.col("lev") * F.col("ret_next")).alias("sr"))
    base = g.where("model = 'ExpandingMean'").select("series", "b", F.col("sse").alias("_e"))
    r2 = (1 - F.col("sse") / F.col("_e")) * 100
    return g.join(base, ["series", "b"]).groupBy("series", "b").agg(F.regr_slope("sr", r2).alias("slope"))


@query("K15_transfer_slope", "SELECT series, quantile_cont(slope, CAST(0.025 AS DOUBLE)) AS lo, median(slope) AS mid, quantile_cont(slope, CAST(0.975 AS DOUBLE)) AS hi FROM sl GROUP BY 1", SLOPE, floats="lo mid hi", digits=4)
def k15(spark, d, of=baseline_race):
    return slopes(spark, d, of).groupBy("series").agg(F.percentile("slope", 0.025).alias("lo"), F.percentile("slope", 0.5).alias("mid"), F.percentile("slope", 0.975).alias("hi"))


TAIL_SLOPE = SLOPE + ", pe AS (SELECT series, b, model, avg(x) * 100 AS es FROM (SELECT i.series, i.b, s.model, s.lev * s.ret_next AS x, row_number() OVER (PARTITION BY i.series, i.b, s.model ORDER BY s.lev * s.ret_next) AS rn, count(*) OVER (PARTITION BY i.series, i.b, s.model) AS n FROM idx i JOIN scored s ON i.series = s.series AND s.t - 36 = i.i) WHERE rn <= greatest(1, floor(CAST(0.05 AS DOUBLE) * n)) GROUP BY ALL), te AS (SELECT a.series, a.b, regr_slope(p.es, (1 - a.sse / e.sse) * 100) AS slope FROM pt a JOIN pt e ON a.series = e.series AND a.b = e.b AND e.model = 'ExpandingMean' JOIN pe p ON p.series = a.series AND p.b = a.b AND p.model = a.model GROUP BY ALL)"


def tail_slopes(spark, d, of=baseline_race):
    """Slope of the shortfall on the forecast's R2 over the models of each replicate."""
    x = bs.resampled(scored(spark, d, of).withColumn("x", F.col("lev") * F.col("ret_next")), REPS, race.FIRST)
    sse = x.groupBy("series", "b", "model").agg(F.sum(F.pow(F.col("y") - F.col("f"), F.lit(2))).alias("sse"))
    g = sse.join(bs.shortfall(x, ["series", "b", "model"], r="x"), ["series", "b", "model"])
    base = sse.where("model = 'ExpandingMean'").select("series", "b", F.col("sse").alias("_e"))
    return g.join(base, ["series", "b"]).groupBy("series", "b").agg(F.regr_slope("es", (1 - F.col("sse") / F.col("_e")) * 100).alias("slope"))


@query("K15b_tail_slope", "SELECT series, quantile_cont(slope, CAST(0.025 AS DOUBLE)) AS lo, median(slope) AS mid, quantile_cont(slope, CAST(0.975 AS DOUBLE)) AS hi FROM te GROUP BY 1", TAIL_SLOPE, floats="lo mid hi", digits=4)
def k15b(spark, d, of=baseline_race):
    return tail_slopes(spark, d, of).groupBy("series").agg(F.percentile("slope", 0.025).alias("lo"), F.percentile("slope", 0.5).alias("mid"), F.percentile("slope", 0.975).alias("hi"))


@query("K16_deflated_sharpe")
def k16(spark, d, of=baseline_race):
    """Against as many trials as there are models, and against 12 and 40."""
    s = strats(spark, d, of)
    own = inf.deflated_sharpe(s).withColumn("trials", F.lit("models"))
    return own.unionByName(inf.deflated_sharpe(s, 12).withColumn("trials", F.lit("12"))).unionByName(inf.deflated_sharpe(s, 40).withColumn("trials", F.lit("40")))


@query("K17_pareto_tail")
def k17(spark, d):
    """Shortfall and value at risk of every daily series, over three thresholds."""
    return tails.pareto(c.series_day(spark, d), ["series"], thresholds=(0.80, 0.85, 0.90))


@query("K18_pareto_bootstrap")
def k18(spark, d, of=baseline_race):
    """Gap of the tails' shortfall to the random walk's: as observed and over the replicates in which both have a tail."""
    levels = lambda t, keys: t.unpivot([*keys, "model"], ["es5", "es1"], "level", "es").where("not isnan(es)")
    own = strats(spark, d, of)
    boot = levels(tails.pareto(bs.resampled(own, TAIL_REPS, race.FIRST), ["series", "model"], "b", least=LEAST_EXCEEDANCES), ["series", "b"])
    seen = levels(tails.pareto(own, ["series", "model"], least=LEAST_EXCEEDANCES), ["series"])
    gaps = bs.against(boot, "es", "RW126", ["series", "b", "level"])
    keys = ["series", "model", "level"]
    obs = bs.against(seen, "es", "RW126", ["series", "level"]).select(*keys, F.col("d").alias("obs"))
    return bs.interval(gaps, keys).join(gaps.groupBy(*keys).agg(F.count("*").alias("n_boot")), keys).join(obs, keys, "left")


@query("K19_hill", "SELECT series, 1 / (avg(CASE WHEN rn <= 20 THEN ln(-r) END) - max(CASE WHEN rn = 21 THEN ln(-r) END)) AS alpha FROM (SELECT series, r, row_number() OVER (PARTITION BY series ORDER BY r) AS rn FROM series_day WHERE r < 0) GROUP BY 1", floats="alpha", digits=4)
def k19(spark, d):
    return inf.hill(c.series_day(spark, d), ["series"])


@query("K20_shortfall_levels", "SELECT series, model, q, avg(r) * 100 AS es FROM (SELECT series, model, q, r, row_number() OVER (PARTITION BY series, model, q ORDER BY r) AS rn, count(*) OVER (PARTITION BY series, model, q) AS n FROM strat, (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE))) g(q)) WHERE rn <= greatest(1, floor(q * n)) GROUP BY ALL", floats="es")
def k20(spark, d, of=baseline_race):
    s = strats(spark, d, of)
    parts = [bs.shortfall(s, ["series", "model"], q).withColumn("q", F.lit(q)) for q in (0.01, 0.05, 0.1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("K21_slope_difference", "SELECT avg(x.slope - y.slope) AS mean, avg(CASE WHEN x.slope - y.slope <= 0 THEN 1.0 ELSE 0.0 END) AS p FROM sl x JOIN sl y USING (b) WHERE x.series = 'wml' AND y.series = 'mkt'", SLOPE, floats="mean p", digits=4)
def k21(spark, d):
    s = slopes(spark, d)
    j = s.where("series = 'wml'").select("b", "slope").join(s.where("series = 'mkt'").select("b", F.col("slope").alias("o")), "b").withColumn("d", F.col("slope") - F.col("o"))
    return j.agg(F.avg("d").alias("mean"), F.avg(F.expr("double(d <= 0)")).alias("p"))


@query("K21b_tail_slope_difference", "SELECT avg(x.slope - y.slope) AS mean, avg(CASE WHEN x.slope - y.slope <= 0 THEN 1.0 ELSE 0.0 END) AS p FROM te x JOIN te y USING (b) WHERE x.series = 'wml' AND y.series = 'mkt'", TAIL_SLOPE, floats="mean p", digits=4)
def k21b(spark, d):
    s = tail_slopes(spark, d)
    j = s.where("series = 'wml'").select("b", "slope").join(s.where("series = 'mkt'").select("b", F.col("slope").alias("o")), "b").withColumn("d", F.col("slope") - F.col("o"))
    return j.agg(F.avg("d").alias("mean"), F.avg(F.expr("double(d <= 0)")).alias("p"))


@saved("lineitem", "part", "supplier", "nation", "region")
def market_race(spark, d):
    return race.race(c.market_day(spark, d).withColumnRenamed("market", "series"))


@saved("lineitem", "part", "supplier", "nation", "region")
def market_forecasts(spark, d):
    return race.baselines(market_race(spark, d))


def markets(spark, d):
    """The race with a market's factor as each series."""
    return market_race(spark, d), market_forecasts(spark, d)


@query("K22b_paired_markets", "SELECT model, avg(x.d - y.d) AS mean, avg(CASE WHEN x.d - y.d <= 0 THEN 1.0 ELSE 0.0 END) AS p FROM df x JOIN df y USING (b, model) WHERE x.series = 'ASIA' AND y.series = 'EUROPE' GROUP BY 1", ES, floats="mean p", digits=5, markets=True)
def k22b(spark, d):
    """Difference of the tail gains in two markets, both drawn with the same blocks."""
    g = shortfall_gaps(bs.shortfall(sample(spark, d, markets), ["series", "b", "model"]))
    j = g.where("series = 'ASIA'").select("b", "model", "d").join(g.where("series = 'EUROPE'").select("b", "model", F.col("d").alias("o")), ["b", "model"]).withColumn("x", F.col("d") - F.col("o"))
    return j.groupBy("model").agg(F.avg("x").alias("mean"), F.avg(F.expr("double(x <= 0)")).alias("p"))


@query("K22_paired_difference", "SELECT model, avg(x.d - y.d) AS mean, avg(CASE WHEN x.d - y.d <= 0 THEN 1.0 ELSE 0.0 END) AS p FROM df x JOIN df y USING (b, model) WHERE x.series = 'win' AND y.series = 'los' GROUP BY 1", ES, floats="mean p", digits=5)
def k22(spark, d):
    g = es_gaps(spark, d)
    j = g.where("series = 'win'").select("b", "model", "d").join(g.where("series = 'los'").select("b", "model", F.col("d").alias("o")), ["b", "model"]).withColumn("x", F.col("d") - F.col("o"))
    return j.groupBy("model").agg(F.avg("x").alias("mean"), F.avg(F.expr("double(x <= 0)")).alias("p"))


@query("K23_jackknife", "SELECT series, model, k, (avg(r) - 2.5 * var_pop(r)) * 1200 AS ce FROM (SELECT series, model, k, r, row_number() OVER (PARTITION BY series, model, k ORDER BY r, t) AS rn FROM strat, (VALUES (1), (3), (5)) g(k)) WHERE rn > k GROUP BY ALL", floats="ce", digits=5)
def k23(spark, d, of=baseline_race):
    rn = F.row_number().over(W.partitionBy("series", "model").orderBy("r", "t"))
    x = strats(spark, d, of).withColumn("rn", rn).withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).where("rn > k")
    return x.groupBy("series", "model", "k").agg(metrics.mv_certainty("r", 5).alias("ce"))


@query("K24_placebo_factors", "SELECT series, model, max(sr) - max(pl) AS gain FROM (SELECT series, model, sqrt(12) * avg(r) / stddev_samp(r) AS sr FROM strat WHERE model <> 'plain' GROUP BY ALL) JOIN (SELECT series, sqrt(12) * avg(r) / stddev_samp(r) AS pl FROM strat WHERE model = 'plain' GROUP BY 1) USING (series) GROUP BY ALL", floats="gain", digits=5)
def k24(spark, d, of=baseline_race):
    g = strats(spark, d, of).groupBy("series", "model").agg(metrics.sharpe("r").alias("sr"))
    return g.where("model != 'plain'").join(g.where("model = 'plain'").select("series", F.col("sr").alias("pl")), "series").select("series", "model", (F.col("sr") - F.col("pl")).alias("gain"))


PLACEBO = f"""{ANNUAL.strip()},
series_day AS (SELECT * FROM (SELECT 'wml' AS series, date, wml AS r FROM factor_day UNION ALL SELECT 'mkt', date, mkt FROM factor_day UNION ALL SELECT 'smb', date, (sl + sm + sh) / 3 - (bl + bmm + bh) / 3 FROM wide UNION ALL SELECT 'hml', date, (sh + bh) / 2 - (sl + bl) / 2 FROM wide) WHERE r IS NOT NULL)"""
PLACEBO_TAILS = IDX + """, each AS (SELECT series, model, list_avg(list_sort(list(r))[1:greatest(1, CAST(floor(CAST(0.05 AS DOUBLE) * count(*)) AS INTEGER))]) * 100 AS es, sqrt(12) * avg(r) / stddev_pop(r) AS sharpe FROM strat GROUP BY ALL),
rs AS (SELECT series, b, model, list_avg(list_sort(list(r))[1:greatest(1, CAST(floor(CAST(0.05 AS DOUBLE) * count(*)) AS INTEGER))]) * 100 AS es FROM samp GROUP BY ALL),
pairs AS (SELECT DISTINCT model, CASE WHEN model = 'RW126' THEN 'plain' ELSE 'RW126' END AS base FROM strat WHERE model <> 'plain'),
pl AS (SELECT a.series, a.model, base, avg(CASE WHEN a.es - z.es <= 0 THEN 1.0 ELSE 0.0 END) AS p_le0 FROM rs a JOIN pairs USING (model) JOIN rs z ON z.series = a.series AND z.b = a.b AND z.model = base GROUP BY ALL)"""


@saved("lineitem", "part")
def placebo_day(spark, d):
    """Daily factors to which the same management is applied: momentum, market, size and value. The factor is the parallel key."""
    sorted_ = factors.size_value(c.px_month(spark, d), c.ret_day(spark, d), c.days(spark, d)).unpivot("date", ["smb", "hml"], "series", "r")
    return c.series_day(spark, d).where("series in ('wml', 'mkt')").select("series", "date", "r").unionByName(sorted_.select("series", "date", "r")).where("r is not null")


@saved("lineitem", "part")
def placebo_race(spark, d):
    return race.race(placebo_day(spark, d))


@saved("lineitem", "part")
def placebo_forecasts(spark, d):
    return race.baselines(placebo_race(spark, d))


def placebos(spark, d):
    return placebo_race(spark, d), placebo_forecasts(spark, d)


@saved("lineitem", "part")
def placebo_features(spark, d):
    return forecast.features(placebo_day(spark, d))


@saved("lineitem", "part")
def placebo_fitted(spark, d):
    x = placebo_features(spark, d)
    return forecast.run(x, ["HAR", "HARX", "Ridge", "Lasso", "HGB"]).unionByName(race.baselines(x))


def whole_placebos(spark, d):
    f = placebo_fitted(spark, d)
    return placebo_features(spark, d), f.unionByName(forecast.ensemble(f, ["HAR", "Ridge", "HGB"]))


@query("K24b_placebo_tails", "SELECT m.series, m.model, base, m.es, m.es - z.es AS d_es, m.sharpe - z.sharpe AS d_sharpe, p_le0 FROM pl JOIN each m USING (series, model) JOIN each z ON z.series = m.series AND z.model = base", PLACEBO_TAILS, floats="es d_es d_sharpe p_le0", digits=4, series=PLACEBO)
def k24b(spark, d, of=placebos):
    """Tail and Sharpe gain of each model for every factor against its own benchmark: the plain factor for the random walk, the random walk for the others."""
    s = strats(spark, d, of)
    benchmark = F.when(F.col("model") == "RW126", F.lit("plain")).otherwise(F.lit("RW126"))
    gaps = lambda t, keys, cols: t.where("model != 'plain'").withColumn("base", benchmark).join(t.select(*keys, F.col("model").alias("base"), *(F.col(x).alias(f"_{x}") for x in cols)), [*keys, "base"])
    seen = gaps(s.groupBy("series", "model").agg(bs.tail_mean("r").alias("es"), bs.sharpe_pop().alias("sharpe")), ["series"], ["es", "sharpe"])
    boot = gaps(bs.shortfall(sample(spark, d, of), ["series", "b", "model"]), ["series", "b"], ["es"])
    p = boot.groupBy("series", "model").agg(F.avg(F.expr("double(es - _es <= 0)")).alias("p_le0"))
    return seen.join(p, ["series", "model"]).select("series", "model", "base", "es", (F.col("es") - F.col("_es")).alias("d_es"), (F.col("sharpe") - F.col("_sharpe")).alias("d_sharpe"), "p_le0")


@query("K24br_placebo_tails_race")
def k24br(spark, d):
    """The same with six fitted models beside the baselines."""
    return k24b(spark, d, whole_placebos)


@query("K25_mechanism_proxies", "SELECT series, vv, rank() OVER (ORDER BY vv DESC) + (count(*) OVER (PARTITION BY vv) - 1) / 2.0 AS rk, surprise FROM (SELECT series, stddev_samp(x) AS vv FROM (SELECT series, ln(rv) - lag(ln(rv)) OVER (PARTITION BY series ORDER BY month) AS x FROM series_month WHERE rv > 0) GROUP BY 1) JOIN (SELECT series, avg(CASE WHEN lv < med THEN 1.0 ELSE 0.0 END) AS surprise FROM (SELECT series, lag(rv) OVER (PARTITION BY series ORDER BY month) AS lv, median(rv) OVER (PARTITION BY series) AS med, row_number() OVER (PARTITION BY series ORDER BY ret, month) AS rn FROM series_month) WHERE rn <= 10 GROUP BY 1) USING (series)", floats="vv rk surprise")
def k25(spark, d):
    m, o, p = months(spark, d), W.partitionBy("series").orderBy("month"), W.partitionBy("series")
    vv = m.where("rv > 0").select("series", (F.ln("rv") - F.lag(F.ln("rv")).over(o)).alias("x")).groupBy("series").agg(F.stddev_samp("x").alias("vv"))
    bad = m.join(m.groupBy("series").agg(F.percentile("rv", 0.5).alias("med")), "series").withColumn("lv", F.lag("rv").over(o)).withColumn("rn", F.row_number().over(p.orderBy("ret", "month"))).where("rn <= 10")
    share = bad.groupBy("series").agg(F.avg(F.when(F.col("lv") < F.col("med"), 1.0).otherwise(0.0)).alias("surprise"))
    return vv.join(share, "series").select("series", "vv", rolling.mean_rank("vv", [], ascending=False).alias("rk"), "surprise")


MECHANISM = """bm AS (SELECT series, month, ret, rv, CASE WHEN count(*) OVER a = 24 THEN CASE WHEN round(sum(ret) OVER a, 9) < 0 THEN 1.0 ELSE 0.0 END END AS bear, pow(lead(ret) OVER o, 2) AS y FROM series_month WINDOW a AS (PARTITION BY series ORDER BY month ROWS 23 PRECEDING), o AS (PARTITION BY series ORDER BY month)),
mr AS (SELECT *, ln(rv) - lag(ln(rv)) OVER o AS dl, lag(rv) OVER o AS lv, median(rv) OVER p AS med, row_number() OVER (PARTITION BY series ORDER BY ret, month) AS rn, count(*) OVER p AS n FROM bm WHERE bear IS NOT NULL AND y IS NOT NULL AND rv > 0 WINDOW o AS (PARTITION BY series ORDER BY month), p AS (PARTITION BY series)),
ms AS (SELECT series, count(*) AS n, stddev_samp(dl) AS vv, avg(CASE WHEN lv <= med THEN 1.0 ELSE 0.0 END) FILTER (rn <= greatest(3, floor(CAST(0.05 AS DOUBLE) * n))) AS surprise, regr_sxx(y, rv) AS s11, regr_sxx(y, rv * bear) AS s22, covar_pop(rv, rv * bear) * count(*) AS s12, regr_sxy(y, rv) AS s1y, regr_sxy(y, rv * bear) AS s2y, regr_syy(y, rv) AS syy FROM mr GROUP BY 1),
mb AS (SELECT series, n, vv, surprise, abs(b2 / sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3) * s11 / det)) AS bear_nonlin_t FROM (SELECT *, (s1y * s22 - s2y * s12) / det AS b1, (s2y * s11 - s1y * s12) / det AS b2 FROM (SELECT *, CASE WHEN n > 3 AND s11 * s22 - s12 * s12 > 1e-11 * s11 * s22 THEN s11 * s22 - s12 * s12 END AS det FROM ms)))"""


@query("K25b_mechanism_ranks", "SELECT *, rank() OVER (ORDER BY vv DESC) + (count(*) OVER (PARTITION BY vv) - 1) / 2.0 + rank() OVER (ORDER BY bear_nonlin_t DESC) + (count(*) OVER (PARTITION BY bear_nonlin_t) - 1) / 2.0 + rank() OVER (ORDER BY surprise DESC) + (count(*) OVER (PARTITION BY surprise) - 1) / 2.0 AS rank_sum FROM mb", MECHANISM, floats="vv bear_nonlin_t surprise rank_sum", digits=4, markets=True)
def k25b(spark, d):
    """Of each market: volatility of volatility, the t value of variance in bear markets for next month's squared return, how often a worst month came after calm, and the sum of its ranks."""
    o, p = W.partitionBy("series").orderBy("month"), W.partitionBy("series")
    m = race.months(c.market_day(spark, d).withColumnRenamed("market", "series"))
    bear = F.expr("double(round(total, 9) < 0)")
    m = m.withColumn("total", rolling.full(F.sum("ret"), "ret", rolling.trailing(["series"], "month", 24), 24)).withColumn("y", F.pow(F.lead("ret").over(o), F.lit(2))).where("total is not null and y is not null and rv > 0").withColumn("bear", bear)
    fit = regression.least_squares(m, F.col("y"), {"rv": F.col("rv"), "rv_bear": F.col("rv") * F.col("bear")}, ["series"]).where("term = 'rv_bear'").select("series", F.abs("t").alias("bear_nonlin_t"))
    m = m.withColumn("x", F.ln("rv") - F.lag(F.ln("rv")).over(o)).withColumn("lv", F.lag("rv").over(o)).withColumn("rn", F.row_number().over(p.orderBy("ret", "month")))
    each = m.groupBy("series").agg(F.count("*").alias("n"), F.stddev_samp("x").alias("vv"), F.percentile("rv", 0.5).alias("med"))
    calm = m.join(each, "series").where(F.col("rn") <= F.greatest(F.lit(3), F.floor(0.05 * F.col("n")))).groupBy("series").agg(F.avg(F.expr("case when lv <= med then 1.0d else 0.0d end")).alias("surprise"))
    j = each.drop("med").join(fit, "series").join(calm, "series")
    ranks = sum((rolling.mean_rank(x, [], ascending=False) for x in ("bear_nonlin_t", "surprise")), rolling.mean_rank("vv", [], ascending=False))
    return j.withColumn("rank_sum", ranks)


MK = "mm AS (SELECT market, last_day(date) AS month, product(1 + r) - 1 AS ret, sum(r * r) AS rv FROM market_day GROUP BY ALL), ms AS (SELECT market, sqrt(12) * avg(ret) / stddev_samp(ret) AS sr, min(ret) AS worst FROM mm GROUP BY 1)"


@query("K26_cross_market", "SELECT regr_slope(worst, sr) AS slope, corr(a, b) AS rho FROM (SELECT worst, sr, rank() OVER (ORDER BY worst) AS a, rank() OVER (ORDER BY sr) AS b FROM ms)", MK, floats="slope rho", digits=5)
def k26(spark, d):
    m = legs_months(spark, d).groupBy("market").agg(metrics.sharpe("ret").alias("sr"), F.min("ret").alias("worst"))
    return m.select("worst", "sr", rolling.mean_rank("worst", []).alias("a"), rolling.mean_rank("sr", []).alias("b")).agg(F.regr_slope("worst", "sr").alias("slope"), F.corr("a", "b").alias("rho"))


@query("K26b_cross_market_gain", "SELECT regr_slope(gain, sr) AS slope, corr(a, b) AS rho FROM (SELECT gain, sr, rank() OVER (ORDER BY gain) AS a, rank() OVER (ORDER BY sr) AS b FROM (SELECT series, max(es) FILTER (model = 'RW126') - max(es) FILTER (model = 'plain') AS gain, max(sr) FILTER (model = 'plain') AS sr FROM (SELECT series, model, avg(CASE WHEN rn <= greatest(1, floor(CAST(0.05 AS DOUBLE) * n)) THEN r END) * 100 AS es, sqrt(12) * avg(r) / stddev_samp(r) AS sr FROM (SELECT *, row_number() OVER (PARTITION BY series, model ORDER BY r) AS rn, count(*) OVER (PARTITION BY series, model) AS n FROM strat) GROUP BY ALL) GROUP BY 1))", floats="slope rho", digits=5, markets=True)
def k26b(spark, d):
    """Tail gain of variance management against the plain factor's Sharpe ratio, over markets."""
    s = strats(spark, d, markets)
    g = s.groupBy("series", "model").agg(metrics.sharpe("r").alias("sr")).join(bs.shortfall(s, ["series", "model"]), ["series", "model"])
    of = lambda model, x: F.max(F.when(F.col("model") == model, F.col(x)))
    m = g.groupBy("series").agg((of("RW126", "es") - of("plain", "es")).alias("gain"), of("plain", "sr").alias("sr"))
    return m.select("gain", "sr", rolling.mean_rank("gain", []).alias("a"), rolling.mean_rank("sr", []).alias("b")).agg(F.regr_slope("gain", "sr").alias("slope"), F.corr("a", "b").alias("rho"))


def legs_months(spark, d):
    return race.months(c.market_day(spark, d), "market")


@query("K27_half_samples", "SELECT series, model, CASE WHEN t < mid THEN 1 ELSE 2 END AS half, sqrt(12) * avg(r) / stddev_samp(r) AS sharpe FROM strat JOIN (SELECT series, median(t) AS mid FROM strat GROUP BY 1) USING (series) GROUP BY ALL", floats="sharpe", digits=5)
def k27(spark, d, of=baseline_race):
    s = strats(spark, d, of)
    return s.join(s.groupBy("series").agg(F.percentile("t", 0.5).alias("mid")), "series").groupBy("series", "model", F.when(F.col("t") < F.col("mid"), 1).otherwise(2).alias("half")).agg(metrics.sharpe("r").alias("sharpe"))


@query("K27b_window_shift", "SELECT series, model, cut, sqrt(12) * avg(r) / stddev_samp(r) AS sharpe, count(*) AS n FROM strat, (VALUES (0), (6), (12)) g(cut) WHERE t >= 36 + cut GROUP BY ALL", floats="sharpe", digits=5)
def k27b(spark, d, of=baseline_race):
    """The same forecasts evaluated from later starts."""
    s = strats(spark, d, of).withColumn("cut", F.explode(F.array(F.lit(0), F.lit(6), F.lit(12)))).where(F.col("t") >= race.FIRST + F.col("cut"))
    return s.groupBy("series", "model", "cut").agg(metrics.sharpe("r").alias("sharpe"), F.count("*").alias("n"))


@query("K28_verdict", f"SELECT series, model, CASE WHEN boot_mean > 0 AND p_le0 < 0.1 THEN 'supported' WHEN boot_mean > 0 THEN 'mixed' ELSE 'rejected' END AS verdict FROM ({SUMMARY})", SH)
def k28(spark, d, of=baseline_race):
    s = summary(stats(spark, d, of), "sharpe")
    return s.select("series", "model", inf.verdict("boot_mean", "p_le0").alias("verdict"))


@query("J12_replicate_product", "SELECT series, b, count(*) AS n, avg(r) AS mean FROM samp WHERE model = 'plain' GROUP BY ALL", IDX, floats="mean")
def j12(spark, d):
    return bs.resampled(strats(spark, d).where("model = 'plain'"), REPS, race.FIRST).groupBy("series", "b").agg(F.count("*").alias("n"), F.avg("r").alias("mean"))


# ---- the same over all twelve models, which SQL can't fit


@query("K01r_leaderboard_race")
def k01r(spark, d):
    """The leaderboard of the whole race with the test against the random walk and its two-sided p-value."""
    test = k02r(spark, d).withColumnRenamed("stat", "dm")
    return k01(spark, d, whole_race).join(test, ["series", "model"], "left")


@query("K02r_diebold_mariano_race")
def k02r(spark, d):
    return k02(spark, d, whole_race).withColumn("p", 2 * (1 - inf.normal_cdf(F.abs("stat"))))


@query("K03r_clark_west_race")
def k03r(spark, d):
    return k03(spark, d, whole_race).withColumn("p", 1 - inf.normal_cdf("t"))


@query("K07r_sharpe_gap_race")
def k07r(spark, d):
    return k07(spark, d, whole_race).withColumn("p", 2 * (1 - inf.normal_cdf(F.abs("z"))))


for _name, _fn in (("K04r_conditional_hac", k04), ("K09r_sharpe_bootstrap", k09), ("K10r_tail_bootstrap", k10), ("K10br_tail_statistics", k10b), ("K11r_certainty_bootstrap", k11), ("K11br_power_utility_bootstrap", k11b), ("K12r_family_max", k12), ("K13r_step_down", k13), ("K14r_reality_check", k14), ("K14br_reality_check_adjusted", k14b), ("K15r_transfer_slope", k15), ("K15br_tail_slope", k15b), ("K16r_deflated_sharpe", k16), ("K18r_pareto_bootstrap", k18), ("K20r_shortfall_levels", k20), ("K23r_jackknife", k23), ("K24r_placebo_factors", k24), ("K27r_half_samples", k27), ("K27br_window_shift", k27b), ("K28r_verdict", k28)):
    query(f"{_name}_race")(partial(_fn, of=whole_race))
