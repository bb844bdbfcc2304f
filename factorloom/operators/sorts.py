"""Cross-sectional sorts by exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile_buckets(df: DataFrame, value: str, bins: int, by: list[str], name: str = "bucket") -> DataFrame:
    """Right-closed buckets by quantile edges of each group, the lowest value included, equal edges dropped.

    Edges are one small row a group; a value's bucket is the number of interior edges below it.
    """
    at = F.array(*(F.lit(k / bins) for k in range(bins + 1)))
    edges = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_distinct(F.percentile(value, at)).alias("_edges"))
    inner = F.slice("_edges", F.lit(2), F.greatest(F.lit(0), F.size("_edges") - 2))
    below = F.size(F.filter(inner, lambda e: e < F.col(value))).cast("long")
    return df.join(edges, by).withColumn(name, F.when(F.col(value).isNotNull(), below)).withColumn("_last", (F.size("_edges") - 2).cast("long")).drop("_edges")


def quantile_of(df: DataFrame, value: str, q: float, by: list[str], name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile(value, q).alias(name))


def corner(size: Column, median: Column, x: Column, low: Column, high: Column) -> Column:
    """Six-way group of a 2x3 sort: S or B by the median, L, M or H by the 30 and 70 per cent points."""
    second = F.when(x <= low, "L").when(x >= high, "H").otherwise("M")
    return F.concat(F.when(size < median, F.lit("S")).otherwise(F.lit("B")), second)
