"""Windows over ordered series. A frame counts only when it is full; `by` names the parallel keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def ordered(by: list[str], order: str) -> WindowSpec:
    return W.partitionBy(*by).orderBy(order)


def trailing(by: list[str], order: str, w: int) -> WindowSpec:
    return ordered(by, order).rowsBetween(-(w - 1), 0)


def full(agg: Column, value: str | Column, over: WindowSpec, least: int) -> Column:
    """The aggregate where the frame has at least `least` non-null values."""
    return F.when(F.count(value).over(over) >= least, agg.over(over))


def variance_forecast(r: str, over: WindowSpec, least: int, days: float = 21) -> Column:
    """Next month's variance as `days` times the mean squared return of the frame."""
    return days * full(F.avg(F.col(r) * F.col(r)), r, over, least)


def annual_vol(r: str, over: WindowSpec, w: int, periods: int = 252) -> Column:
    """Annualised volatility from the sum of squares of a full frame."""
    return F.sqrt(full(F.sum(F.col(r) * F.col(r)), r, over, w) * (periods / w))


def index_level(r: str, by: list[str], order: str) -> Column:
    return F.product(1 + F.coalesce(F.col(r), F.lit(0.0))).over(ordered(by, order).rowsBetween(W.unboundedPreceding, 0))


def change(x: str, by: list[str], order: str, k: int) -> Column:
    return F.try_divide(F.col(x), F.lag(x, k).over(ordered(by, order))) - 1


def drawdown(level: str, by: list[str], order: str) -> Column:
    return F.try_divide(F.col(level), F.max(level).over(ordered(by, order).rowsBetween(W.unboundedPreceding, 0))) - 1


def forward(by: list[str], order: str, w: int = 12) -> WindowSpec:
    return ordered(by, order).rowsBetween(1, w)


def expanding_before(by: list[str], order: str) -> WindowSpec:
    return ordered(by, order).rowsBetween(W.unboundedPreceding, -1)


def mean_rank(value: str | Column, by: list[str], ascending: bool = True) -> Column:
    """Average rank of ties."""
    v = F.col(value) if isinstance(value, str) else value
    return F.rank().over(W.partitionBy(*by).orderBy(v.asc() if ascending else v.desc())) + (F.count(F.lit(1)).over(W.partitionBy(*by, v)) - 1) / 2
