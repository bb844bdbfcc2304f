"""Queries of the forecast race's estimators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.functions import kernels
from factorloom.operators import calendar, forecast, metrics, race, rolling, scans, strategy
from factorloom.plans.portfolios import baselines, grid_days, grid_race, race_of
from factorloom.plans.registry import query
from factorloom.sources import catalog as c
from factorloom.sources.shared import saved


def baseline(model):
    def run(spark, d):
        return baselines(spark, d).where(F.col("model") == model).select("series", "t", "f")

    return run


for _name, _model in (("M01_expanding_mean", "ExpandingMean"), ("M02_random_walk", "RW126"), ("M03_ewma_tuned", "EWMA")):
    query(_name, f"SELECT series, t, f FROM forecasts WHERE model = '{_model}'", floats="f", digits=8)(baseline(_model))


@saved("lineitem", "part")
def race_features(spark, d):
    return forecast.features(c.series_day(spark, d))


@saved("lineitem", "part")
def fitted(spark, d):
    """Forecasts of the eleven single models in the same months."""
    x = race_features(spark, d)
    own = forecast.run(x, list(forecast.ESTIMATORS)).unionByName(race.baselines(x))
    return own.unionByName(forecast.run_lstm(x, forecast.HARX).withColumn("model", F.lit("LSTM")))


ENSEMBLE = ["HAR", "Ridge", "HGB"]


def whole_race(spark, d):
    """The race's rows and the forecasts of all twelve models; ENS is the mean of three of them."""
    f = fitted(spark, d)
    return race_features(spark, d), f.unionByName(forecast.ensemble(f, ENSEMBLE))


def estimator(model, **options):
    def run(spark, d):
        return forecast.run(race_features(spark, d), [model], **options)

    return run


for _name, _model in (("M04_har", "HAR"), ("M05_harx", "HARX"), ("M06_ridge", "Ridge"), ("M07_lasso", "Lasso"), ("M08_forest", "RF"), ("M09_boosting", "HGB"), ("M10_mlp", "MLP")):
    query(_name)(estimator(_model))


@query("M11_lstm")
def m11(spark, d):
    return forecast.run_lstm(race_features(spark, d), forecast.HARX)


@query("M12s_simple_mean", "SELECT series, t, 'ENS' AS model, avg(f) AS f FROM forecasts WHERE model IN ('RW126', 'EWMA') GROUP BY ALL", floats="f", digits=8)
def m12s(spark, d):
    """The mean of two forecasts that SQL can repeat."""
    return forecast.ensemble(baselines(spark, d), ["RW126", "EWMA"])


@query("M12_ensemble")
def m12(spark, d):
    """The reference's ensemble, of estimators that SQL can't express."""
    return forecast.ensemble(fitted(spark, d), ENSEMBLE)


SEEDS = (0, 7, 13, 21, 42)


@query("M13_seed_sweep")
def m13(spark, d):
    x = race_features(spark, d)
    own = {f"MLP{s}": (forecast.HARX, kernels.standardised(kernels.mlp(seed=s))) for s in SEEDS}
    f = forecast.run(x, list(own), estimators=own).unionByName(forecast.run_lstm(x, forecast.HARX, seeds=SEEDS)).join(x.select("series", "t", "y"), ["series", "t"])
    each = f.groupBy("series", "model").agg(F.avg(metrics.qlike("y", "f")).alias("qlike"))
    return each.groupBy("series", F.regexp_replace("model", "[0-9]+$", "").alias("model")).agg(F.avg("qlike").alias("mean"), F.min("qlike").alias("least"), F.max("qlike").alias("most"))


@query("M14_forward_folds", "SELECT t0, i, t0 - (3 - i) * (t0 // 4) AS train_end, t0 - (2 - i) * (t0 // 4) AS test_end FROM (SELECT unnest(range(36, 73, 6)) AS t0), (SELECT unnest(range(3)) AS i)")
def m14(spark, d):
    rows = [(t0, i, int(te[0]), int(te[-1]) + 1) for t0 in range(36, 73, 6) for i, (_, te) in enumerate(kernels.forward_splits(t0))]
    return spark.createDataFrame(rows, "t0 long, i long, train_end long, test_end long")


@query("M14b_fold_means", "SELECT f.series, f.t0, i, f.t0 - (3 - i) * (f.t0 // 4) AS train_end, f.t0 - (2 - i) * (f.t0 // 4) AS test_end, avg(y) FILTER (t < f.t0 - (3 - i) * (f.t0 // 4)) * 1e4 AS train, avg(y) FILTER (t >= f.t0 - (3 - i) * (f.t0 // 4)) * 1e4 AS test FROM folds f CROSS JOIN (SELECT unnest(range(3)) AS i) JOIN race r ON r.series = f.series AND t < f.t0 - (2 - i) * (f.t0 // 4) GROUP BY ALL", floats="train test")
def m14b(spark, d):
    """The forward splits of every series' folds with the mean target of their two parts."""
    return forecast.split_means(race_of(spark, d), 3)


@query("M15_scaler", "SELECT series, t0, avg(y) * 1e4 AS mean, stddev_pop(y) * 1e4 AS sd FROM race JOIN folds USING (series) WHERE t < t0 GROUP BY ALL", floats="mean sd")
def m15(spark, d):
    x = forecast.fold_rows(race_of(spark, d)).where("t < t0")
    return x.groupBy("series", F.col("t0").cast("long").alias("t0")).agg((F.avg("y") * 1e4).alias("mean"), (F.stddev_pop("y") * 1e4).alias("sd"))


@query("J13_prefix_join", "SELECT series, t0, count(*) AS n, max(t) AS last FROM race JOIN folds USING (series) WHERE t < t0 GROUP BY ALL")
def j13(spark, d):
    return forecast.fold_rows(race_of(spark, d)).where("t < t0").groupBy("series", F.col("t0").cast("long").alias("t0")).agg(F.count("*").alias("n"), F.max("t").alias("last"))


@query("M16_component_forecasts")
def m16(spark, d):
    """Market and specific variance of the factor, each forecast and clipped to the training range."""
    a = rolling.trailing(["_block"], "t", 126)
    f = scans.overlapping(calendar.with_ordinal(c.factor_day(spark, d).where("wml is not null"), "date", "t"), "t", 126)
    beta = F.covar_samp("wml", "mkt").over(a) / F.var_samp("mkt").over(a)
    x = f.withColumn("_n", F.count("*").over(a)).withColumn("_m", beta * F.col("mkt")).where("_own and _n >= 126")
    parts = x.select("date", F.col("_m").alias("market"), (F.col("wml") - F.col("_m")).alias("specific")).unpivot("date", ["market", "specific"], "series", "r")
    return forecast.run(forecast.features(parts), ["Ridge"], transform="clip")


@query("M17_semivariance_target")
def m17(spark, d):
    x = race_features(spark, d)
    down = F.lead(F.col("x_down") * F.col("rv")).over(W.partitionBy("series").orderBy("t"))
    return forecast.run(x.withColumn("down_next", F.greatest(down, F.lit(1e-8))).where("down_next is not null"), ["Ridge"], target="down_next")


def semivariance_rows(spark, d):
    """Race rows with this half year's mean downside semivariance and next month's as a target."""
    x = race_features(spark, d).withColumn("down", F.col("x_down") * F.col("rv"))
    o = W.partitionBy("series").orderBy("t")
    half = rolling.full(F.avg("down"), "down", o.rowsBetween(-5, 0), 6)
    x = x.withColumns({"down_next": F.lead("down").over(o), "down_half": half}).where("down_next is not null")
    return x.withColumns({k: F.when(F.col(k).isNotNull(), F.greatest(k, F.lit(1e-8))) for k in ("down_next", "down_half")})


@query("M17b_variance_or_semivariance")
def m17b(spark, d):
    """What to forecast: returns managed by total variance or by twice the downside semivariance, each fitted or as last seen."""
    x = semivariance_rows(spark, d)
    ridge = {target: forecast.run(x, ["Ridge"], transform="smear and clip", target=target).select("series", "t", F.col("f").alias(f"f_{target}")) for target in ("y", "down_next")}
    j = x.where(F.col("t") >= race.FIRST).join(ridge["y"], ["series", "t"]).join(ridge["down_next"], ["series", "t"])
    by = {"RW126": F.col("fvar"), "RW-semi": 2 * F.col("down_half"), "Ridge": F.col("f_y"), "Ridge-semi": 2 * F.col("f_down_next")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("model"), (F.lit(race.TARGET / 12**0.5) / F.sqrt(v) * F.col("ret_next")).alias("r")) for k, v in by.items())))
    r = j.select("series", "t", each.alias("_s")).select("series", "t", "_s.*")
    r = r.withColumn("level", rolling.index_level("r", ["series", "model"], "t")).withColumn("fall", rolling.drawdown("level", ["series", "model"], "t"))
    return r.groupBy("series", "model").agg(F.count("r").alias("n"), metrics.sharpe("r", population=True).alias("sharpe"), F.skewness("r").alias("skew"), (F.min("r") * 100).alias("worst"), (F.min("fall") * 100).alias("drawdown"))


@saved("lineitem", "part")
def mean_forecasts(spark, d):
    """Race rows of the test folds with the ridge forecast of next month's return, fitted in levels: series, t, mu."""
    f = forecast.run(race_features(spark, d), ["Ridge"], transform="level", target="ret_next")
    return f.select("series", "t", F.col("f").alias("mu"))


@query("M17c_mean_in_levels")
def m17c(spark, d):
    """Out-of-sample R2 of the mean forecast against the mean of all earlier returns, in per cent."""
    x = race_features(spark, d).withColumn("past", F.avg("ret_next").over(rolling.expanding_before(["series"], "t")))
    j = x.join(mean_forecasts(spark, d), ["series", "t"]).where("ret_next is not null")
    sse = lambda f: F.sum(F.pow(F.col("ret_next") - F.col(f), 2))
    return j.groupBy("series").agg(F.count("*").alias("n"), ((1 - F.try_divide(sse("mu"), sse("past"))) * 100).alias("r2"))


DM = "train AS (SELECT series, t0, avg(ret_next) AS mean, (0.12 / sqrt(12)) * avg(sqrt(fvar)) / greatest(abs(avg(ret_next)), 1e-9) / avg(fvar) AS scale FROM race JOIN folds USING (series) WHERE t < t0 GROUP BY ALL)"


@query("T09b_normalised_mean_variance", "SELECT series, t, scale * mean / fvar AS free, least(greatest(scale * mean / fvar, 0), 2) AS lev, least(greatest(scale * mean / fvar, 0), 2) * ret_next AS r FROM race JOIN fold_of USING (series, t) JOIN train USING (series, t0)", DM, floats="free lev r", digits=5)
def t09b(spark, d):
    """Mean over variance with the training mean, scaled on the training rows."""
    return strategy.normalised_dynamic(race_of(spark, d), None, race.FIRST, race.REFIT, race.TARGET / 12**0.5)


@query("T09r_mean_variance_ridge")
def t09r(spark, d):
    """Mean over variance with the mean of earlier returns and with the ridge mean, beside variance alone."""
    x = race_features(spark, d)
    own = x.join(mean_forecasts(spark, d), ["series", "t"], "left")
    dynamic = lambda mu: strategy.normalised_dynamic(own, mu, race.FIRST, race.REFIT, race.TARGET / 12**0.5)
    only = x.where(F.col("t") >= race.FIRST).select("series", "t", race.leverage("fvar").alias("lev")).join(x.select("series", "t", "ret_next"), ["series", "t"])
    parts = {"mean": dynamic(None).drop("free"), "ridge": dynamic("mu").drop("free"), "variance": only.select("series", "t", "lev", (F.col("lev") * F.col("ret_next")).alias("r"))}
    all_ = reduce(DataFrame.unionByName, [p.withColumn("model", F.lit(k)) for k, p in parts.items()])
    return all_.groupBy("series", "model").agg(F.count("r").alias("n"), metrics.sharpe("r", population=True).alias("sharpe"), F.skewness("r").alias("skew"), (F.min("r") * 100).alias("worst"), F.avg("lev").alias("lev"))


@query("M18_crash_classifier")
def m18(spark, d):
    return forecast.crash_probability(race_features(spark, d), forecast.HARX, fall=-0.02)


@query("T14_crash_overlay")
def t14(spark, d):
    x = race_features(spark, d)
    p = forecast.crash_probability(x, forecast.HARX, fall=-0.02)
    lev = race.leverage("fvar") * F.least(F.greatest(1 - F.col("p"), F.lit(0.2)), F.lit(1.0))
    return x.join(p, ["series", "t"]).select("series", "t", "model", (lev * F.col("ret_next")).alias("r")).groupBy("series", "model").agg(F.count("*").alias("n"), metrics.sharpe("r").alias("sharpe"))


@query("T07r_construction_grid_ridge")
def t07r(spark, d):
    """The six constructions managed by the ridge forecast."""
    x = forecast.features(grid_days(spark, d))
    own = grid_race(spark, d).select("series", "month", F.col("ret_next").alias("wml"))
    f = forecast.run(x, ["Ridge"], transform="clip").join(x.select("series", "t", "month"), ["series", "t"]).join(own, ["series", "month"])
    return f.groupBy(F.col("series").alias("variant")).agg(metrics.sharpe(race.leverage() * F.col("wml")).alias("sharpe"), (F.min(race.leverage() * F.col("wml")) * 100).alias("worst"), F.count("*").alias("n"))


@query("M18b_auc")
def m18b(spark, d):
    return forecast.auc(forecast.crash_probability(race_features(spark, d), forecast.HARX, fall=-0.02), ["series", "model"])


@query("M19_importance")
def m19(spark, d):
    return forecast.importance(race_features(spark, d), forecast.HARX)


@query("M20_training_start")
def m20(spark, d):
    """HAR and HARX with unlogged features from two training starts."""
    x = race_features(spark, d)
    plain = x.withColumns({k: F.exp(k) for k in ("x_rv1", "x_rv3", "x_rv12", "x_fvar")})
    parts = [forecast.run(rows, [model], first=first).select("series", F.lit(name).alias("model"), F.lit(first).alias("first"), "f") for first in (36, 48) for rows, model, name in ((x, "HAR", "HAR"), (plain, "HARX", "HARX unlogged"))]
    return reduce(DataFrame.unionByName, parts).groupBy("series", "model", "first").agg(F.count("*").alias("n"), F.avg("f").alias("mean"))


@saved("lineitem", "part", "supplier", "nation", "region")
def market_features(spark, d):
    return forecast.features(c.market_day(spark, d).withColumnRenamed("market", "series"))


@saved("lineitem", "part", "supplier", "nation", "region")
def fitted_markets(spark, d):
    """The eleven single models in every market at once: the market is part of the group; variances are clipped to what was seen."""
    x = market_features(spark, d)
    own = forecast.run(x, list(forecast.ESTIMATORS), transform="clip").unionByName(race.baselines(x))
    return own.unionByName(forecast.run_lstm(x, forecast.HARX, transform="clip").withColumn("model", F.lit("LSTM")))


def whole_markets(spark, d):
    """All twelve models in every market; the ensemble is made from the written forecasts, so no model is fitted again for it."""
    f = fitted_markets(spark, d)
    return f.unionByName(forecast.ensemble(f, ENSEMBLE))


@query("M21_markets")
def m21(spark, d):
    """The race of twelve models in every market."""
    return whole_markets(spark, d)


@query("M21b_market_losses")
def m21b(spark, d):
    """Loss of every model in every market, against the 126-day variance in the same months, and its place."""
    s = race.scored(market_features(spark, d), whole_markets(spark, d))
    base = s.where("model = 'RW126'").select("series", "t", F.col("loss").alias("base"))
    m = s.join(base, ["series", "t"]).groupBy("series", "model").agg(F.count("*").alias("n"), F.avg("loss").alias("qlike"), (F.avg("base") - F.avg("loss")).alias("gain"))
    return m.withColumn("place", F.rank().over(W.partitionBy("series").orderBy("qlike")))


@query("M21s_markets_baselines", "SELECT series, t, model, f FROM forecasts", floats="f", digits=8, markets=True)
def m21s(spark, d):
    """The three models that SQL can repeat, over all markets."""
    return race.baselines(race.race(c.market_day(spark, d).withColumnRenamed("market", "series")))
