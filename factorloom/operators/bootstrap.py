"""Circular block bootstrap in sets: replicate is the parallel axis, all models share a replicate's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.operators.forecast import spread

BLOCK = 12
SEED = 42


def block_index(sizes: DataFrame, reps: int, block: int = BLOCK, seed: int = SEED, by: str = "series") -> DataFrame:
    """Rows (by, b, pos, i): the pos-th row of replicate b is row i, in circular blocks. `sizes` has (by, n).

    Starts come from an md5 of replicate and block, so any engine draws the same ones and groups of
    equal length share them.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    each = sizes.select(by, "n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("b"), blocks.alias("_k")).select(by, "n", "b", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("j"))
    hexed = F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string"))), 1, 8)
    started = each.withColumn("start", F.conv(hexed, 16, 10).cast("long") % F.col("n"))
    rows = started.select(by, "n", "b", "start", "j", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o"))
    return rows.withColumn("pos", F.col("j") * block + F.col("o")).where("pos < n").select(by, "b", "pos", ((F.col("start") + F.col("o")) % F.col("n")).alias("i"))


def resampled(table: DataFrame, reps: int, first: int, block: int = BLOCK, by: str = "series") -> DataFrame:
    """The table's rows (by, t, ...) of every replicate: an equi-join on the row number, t - first."""
    n = table.groupBy(by).agg((F.max("t") - first + 1).alias("n"))
    return block_index(n, reps, block, by=by).join(table.withColumn("i", F.col("t") - first), [by, "i"])


def tail_mean(r: str | Column, q: float = 0.05) -> Column:
    """Mean of the max(1, floor(q n)) smallest values as an aggregate, in per cent. A group is a series of periods, whose values it holds."""
    held = F.array_sort(F.collect_list(r))
    least = F.slice(held, F.lit(1), F.greatest(F.lit(1), F.floor(q * F.size(held)).cast("int")))
    return F.try_divide(F.aggregate(least, F.lit(0.0), lambda s, v: s + v), F.size(least)) * 100


def shortfall(df: DataFrame, keys: list[str], q: float = 0.05, r: str = "r", name: str = "es") -> DataFrame:
    """Tail mean of each group, in one pass and without a window."""
    return df.groupBy(*keys).agg(tail_mean(r, q).alias(name))


def drawn(table: DataFrame, reps: int, first: int, block: int = BLOCK, seed: int = SEED, by: str = "series", r: str = "r") -> DataFrame:
    """by, b, model and x: every replicate's values as one array, from the same starts as `block_index`, without exploding or joining rows.

    A series' values are one array a model, read at the drawn places; a model without a value in a period has one less in x. The
    replicates are dealt over the cluster before anything is drawn: they come from few rows, but are all of the work.
    """
    n = table.groupBy(by).agg((F.max("t") - first + 1).alias("_n"))
    held = table.where(F.col(r).isNotNull()).groupBy(by, "model").agg(F.map_from_entries(F.collect_list(F.struct((F.col("t") - first).alias("i"), F.col(r).alias("v")))).alias("_at"))
    values = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.try_element_at("_at", i))
    own = held.join(n, by).groupBy(by, "_n").agg(F.collect_list(F.struct("model", values.alias("r"))).alias("_models"))
    each = spread(own.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))), by, "b")
    hexed = lambda j: F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("b").cast("string"), j.cast("string"))), 1, 8)
    starts = F.transform(F.sequence(F.lit(0), F.ceil(F.col("_n") / block).cast("int") - 1), lambda j: F.conv(hexed(j), 16, 10).cast("long") % F.col("_n"))
    places = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda o: (s + o) % F.col("_n"))))
    drawn_rows = each.select(by, "b", F.slice(places, F.lit(1), F.col("_n").cast("int")).alias("_i"), "_models").select(by, "b", "_i", F.inline("_models"))
    x = F.filter(F.transform("_i", lambda i: F.get("r", i.cast("int"))), lambda v: v.isNotNull())
    return drawn_rows.select(by, "b", "model", x.alias("x"))


def statistics(replicates: DataFrame, q: float = 0.05, gamma: float = 5, power: float = 10) -> DataFrame:
    """All statistics of each replicate's array x in one pass: Sharpe ratio, skewness, worst period, shortfall, and certainty equivalents by mean and variance (aversion gamma) and by power utility."""
    total = lambda f: F.aggregate("x", F.lit(0.0), lambda s, v: s + f(v))
    n = F.size("x")
    base = replicates.withColumns({"_n": n, "_mean": F.try_divide(total(lambda v: v), n), "_low": F.array_min("x"), "_tail": F.slice(F.array_sort("x"), F.lit(1), F.greatest(F.lit(1), F.floor(q * n).cast("int")))})
    gap = lambda v: v - F.col("_mean")
    base = base.withColumns({"_var": F.try_divide(total(lambda v: gap(v) * gap(v)), F.col("_n")), "_third": F.try_divide(total(lambda v: gap(v) * gap(v) * gap(v)), F.col("_n")), "_power": F.when(F.col("_low") > -1, F.try_divide(total(lambda v: F.pow(1 + v, F.lit(1 - power))), F.col("_n")))})
    keys = [c for c in replicates.columns if c != "x"]
    es = F.try_divide(F.aggregate("_tail", F.lit(0.0), lambda s, v: s + v), F.size("_tail")) * 100
    return base.select(
        *keys, (F.sqrt(F.lit(12.0)) * F.try_divide("_mean", F.sqrt("_var"))).alias("sharpe"), F.try_divide("_third", F.pow("_var", F.lit(1.5))).alias("skew"), (F.col("_low") * 100).alias("worst"), es.alias("es"),
        ((F.col("_mean") - gamma / 2 * F.col("_var")) * 1200).alias("mv"), ((F.pow(F.pow("_power", F.lit(1 / (1 - power))), F.lit(12)) - 1) * 100).alias("crra"),
    )


def against(stats: DataFrame, value: str, base: str, keys: list[str]) -> DataFrame:
    """Difference d of each model's value from the base model's in the same replicate."""
    b = stats.where(F.col("model") == base).select(*keys, F.col(value).alias("_base"))
    return stats.where(F.col("model") != base).join(b, keys).withColumn("d", F.col(value) - F.col("_base"))


def interval(diffs: DataFrame, keys: list[str], d: str = "d") -> DataFrame:
    """Mean, 95 % interval and share of replicates at or under 0."""
    return diffs.groupBy(*keys).agg(F.avg(d).alias("boot_mean"), F.percentile(d, 0.025).alias("ci_lo"), F.percentile(d, 0.975).alias("ci_hi"), F.avg(F.expr(f"double({d} <= 0)")).alias("p_le0"))


def step_down(boot: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """Step-down p-values: boot has (by, b, model, d), observed (by, model, obs). Columns t, indiv_p, rw_p.

    Models stand by falling observed t; a model's null is the largest centred statistic of itself and those
    after it; p-values never fall along the order.
    """
    sd = boot.groupBy(*by, "model").agg(F.stddev_pop("d").alias("sd"), F.avg(F.expr("double(d <= 0)")).alias("indiv_p"))
    seen = observed.join(sd, [*by, "model"]).withColumn("t", F.try_divide("obs", "sd"))
    c = boot.join(seen, [*by, "model"]).withColumn("z", F.try_divide(F.col("d") - F.col("obs"), F.col("sd")))
    after = W.partitionBy(*by, "b").orderBy(F.desc("t"), "model").rowsBetween(0, W.unboundedFollowing)
    p = c.withColumn("top", F.max("z").over(after)).groupBy(*by, "model", "t", "indiv_p").agg(F.avg(F.expr("double(top >= t)")).alias("p"))
    return p.withColumn("rw_p", F.max("p").over(W.partitionBy(*by).orderBy(F.desc("t"), "model").rowsBetween(W.unboundedPreceding, 0))).drop("p")


def sharpe_pop(r: str | Column = "r") -> Column:
    return F.sqrt(F.lit(12.0)) * F.try_divide(F.avg(r), F.stddev_pop(r))
