"""Scans over long ordered series in blocks: no task holds a whole series.

A recursion x_t = a_t x_{t-1} + b_t is a composition of affine maps, which is associative: maps are composed inside blocks of
rows, the blocks' totals are composed in the same way, and each block takes over what lies before it. Running sums (1, v), running
products (v, 0), exponential smoothing (lam, (1 - lam) v) and filling forward ((0, v) or (1, 0)) are all of this form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block; two levels of blocks reach over its square, 262,144 rows of a series, and each further level as many times more.
BLOCK = 512


def composed(df: DataFrame, by: list[str], t: str, a: Column, b: Column, before: bool = False, block: int = BLOCK, levels: int = 2) -> DataFrame:
    """Columns _a and _b: the map from the value before the series to that at row t, or with `before` to that at the row before it.

    `t` numbers the rows of each group from 0 without gaps; a series of more than block ** levels rows is an error.
    """
    within = W.partitionBy(*by, "_blk").orderBy(t)
    own = F.floor(F.col(t) / block)
    if levels == 1:
        own = F.when(F.col(t) < block, own).otherwise(F.raise_error(F.lit("a series is longer than the levels of blocks reach")))
    out = df.withColumns({"_blk": own.cast("long"), "_a": a.cast("double"), "_b": b.cast("double")})
    step = 1
    while step < block:
        out = out.withColumns({"_pa": F.lag("_a", step).over(within), "_pb": F.lag("_b", step).over(within)})
        out = out.withColumns({"_b": F.coalesce(F.col("_a") * F.col("_pb") + F.col("_b"), F.col("_b")), "_a": F.coalesce(F.col("_a") * F.col("_pa"), F.col("_a"))})
        step *= 2
    out = out.drop("_pa", "_pb")
    totals = None
    if levels > 1:
        at = f"_at{levels}"
        last = out.groupBy(*by, "_blk").agg(F.max_by(F.struct("_a", "_b"), t).alias("_last")).withColumnRenamed("_blk", at)
        totals = composed(last, by, at, F.col("_last._a"), F.col("_last._b"), block=block, levels=levels - 1)
        totals = totals.select(*by, (F.col(at) + 1).alias("_blk"), F.col("_a").alias("_oa"), F.col("_b").alias("_ob"))
    if before:
        out = out.withColumns({"_a": F.coalesce(F.lag("_a").over(within), F.lit(1.0)), "_b": F.coalesce(F.lag("_b").over(within), F.lit(0.0))})
    if totals is not None:
        out = out.join(totals, [*by, "_blk"], "left")
        out = out.withColumns({"_b": F.col("_a") * F.coalesce("_ob", F.lit(0.0)) + F.col("_b"), "_a": F.col("_a") * F.coalesce("_oa", F.lit(1.0))})
        out = out.drop("_oa", "_ob")
    return out.drop("_blk")


def running_product(df: DataFrame, by: list[str], t: str, factor: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Product of the factors up to each row; a null factor is skipped."""
    return composed(df, by, t, F.coalesce(factor, F.lit(1.0)), F.lit(0.0), block=block).withColumn(name, F.col("_a")).drop("_a", "_b")


def running_sum(df: DataFrame, by: list[str], t: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Sum of the values up to each row; a null value is skipped."""
    return composed(df, by, t, F.lit(1.0), F.coalesce(value, F.lit(0.0)), block=block).withColumn(name, F.col("_b")).drop("_a", "_b")


def filled(df: DataFrame, by: list[str], t: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """The last value that is not null up to each row."""
    there = value.isNotNull()
    return composed(df, by, t, F.when(there, 0.0).otherwise(1.0), F.coalesce(value, F.lit(0.0)), block=block).withColumn(name, F.when(F.col("_a") == 0, F.col("_b"))).drop("_a", "_b")


def smoothed(df: DataFrame, by: list[str], t: str, value: str, lam: str, name: str, seed_rows: int = 12, block: int = BLOCK) -> DataFrame:
    """s_0 = mean of the first rows; s_t = lam s_{t-1} + (1 - lam) value_{t-1}; t counts from 0 in each series.

    lam is a column that is constant in a series; a null value counts as 0.
    """
    seed = df.where(F.col(t) < seed_rows).groupBy(*by).agg(F.avg(value).alias("_seed"))
    steps = composed(df, by, t, F.col(lam), F.coalesce((1 - F.col(lam)) * F.col(value), F.lit(0.0)), before=True, block=block)
    return steps.join(seed, by).withColumn(name, F.col("_a") * F.col("_seed") + F.col("_b")).drop("_a", "_b", "_seed")


def overlapping(df: DataFrame, t: str, w: int, block: int = 4096) -> DataFrame:
    """Rows in blocks, each with the w - 1 rows before it: _block, and _own for a block's own rows.

    Trailing windows of w rows of one series then run in parallel by _block; keep the rows that are _own.
    """
    if block < w:
        raise ValueError("a block must be as long as the window")
    own = F.floor(F.col(t) / block).cast("long")
    reaches = F.col(t) >= (own + 1) * block - (w - 1)
    return df.withColumn("_home", own).withColumn("_block", F.explode(F.when(reaches, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))).withColumn("_own", F.col("_block") == F.col("_home")).drop("_home")
