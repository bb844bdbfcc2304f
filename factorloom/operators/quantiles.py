"""Exact quantiles of groups of any size by selection: counts in bins, then only the bins that hold a wanted rank, again in bins.

`F.percentile` keeps every distinct value of a group in one task. Here a task keeps counts of bins. A cell is cut into
BINS bins between its own least and greatest value, so far outliers cost one level at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 4096
#: Times that cells are cut. What is left of a group is then sorted: of n spread values about n / 4096 ** 2.
LEVELS = 2


def _ranks(sizes: DataFrame, by: list[str], at: list[float]) -> DataFrame:
    """The order statistics on either side of each quantile: q, side, rank from 0 and the weight of the upper one."""
    each = sizes.withColumn("q", F.explode(F.array(*map(F.lit, at)))).withColumn("_pos", F.col("q") * (F.col("_n") - 1))
    low = F.floor("_pos").cast("long")
    sides = F.array(F.struct(low.alias("rank"), (1 - (F.col("_pos") - low)).alias("weight")), F.struct(F.ceil("_pos").cast("long").alias("rank"), (F.col("_pos") - low).alias("weight")))
    return each.withColumn("_s", F.explode(sides)).select(*by, "q", F.col("_s.rank").alias("_rank"), F.col("_s.weight").alias("_weight")).where("_weight > 0")


def _placed(wanted: DataFrame, counts: DataFrame, key: list[str], order: str) -> DataFrame:
    """Wanted ranks with the entry of their cell that holds them, and the rank inside it."""
    w = W.partitionBy(*key).orderBy(order)
    ranged = counts.withColumn("_before", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    return wanted.join(ranged, key).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))).withColumn("_rank", F.col("_rank") - F.col("_before")).drop("_before", "_n")


def exact_quantiles(df: DataFrame, value: str, at: list[float], by: list[str], bins: int = BINS, levels: int = LEVELS) -> DataFrame:
    """by, q and the quantile, linear between order statistics; nulls take no part, and a group without values has no row."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.lit(0).cast("long").alias("_cell"))
    key = [*by, "_cell"]
    wanted = None
    for _ in range(levels):
        cells = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        if wanted is None:
            wanted = _ranks(cells.select(*by, "_n"), by, at).withColumn("_cell", F.lit(0).cast("long"))
        share = F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low"))
        cut = rows.join(cells.drop("_n"), key).withColumn("_bin", F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * bins)).cast("long"))
        counts = cut.groupBy(*key, "_bin").agg(F.count("*").alias("_n"))
        wanted = _placed(wanted, counts, key, "_bin").withColumn("_cell", F.col("_cell") * bins + F.col("_bin")).drop("_bin")
        inside = cut.withColumn("_cell", F.col("_cell") * bins + F.col("_bin")).select(*key, "_v")
        rows = inside.join(wanted.select(*key).distinct(), key, "left_semi")
    counts = rows.groupBy(*key, "_v").agg(F.count("*").alias("_n"))
    found = _placed(wanted, counts, key, "_v")
    return found.groupBy(*by, "q").agg(F.sum(F.col("_v") * F.col("_weight")).alias("value"))


def large_group_buckets(df: DataFrame, value: str, bins: int, by: list[str], name: str = "bucket") -> DataFrame:
    """Right-closed buckets by exact edges, as `sorts.quantile_buckets` gives them, for groups that no task can hold."""
    edges = exact_quantiles(df, value, [k / bins for k in range(bins + 1)], by)
    held = edges.groupBy(*by).agg(F.array_sort(F.array_distinct(F.collect_list("value"))).alias("_edges"))
    inner = F.slice("_edges", F.lit(2), F.greatest(F.lit(0), F.size("_edges") - 2))
    below: Column = F.size(F.filter(inner, lambda e: e < F.col(value))).cast("long")
    return df.join(held, by, "left").withColumn(name, F.when(F.col(value).isNotNull(), below)).drop("_edges")
