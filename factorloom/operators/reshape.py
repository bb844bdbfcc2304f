"""Projection, cleaning and reshaping of long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_by_key(df: DataFrame, value: str, order: str, keys: list[str], name: str) -> DataFrame:
    """Last non-null value of each key."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, order).alias(name))


def first_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_rn = 1").drop("_rn")


def guard(r: str, cap: str | float) -> Column:
    """The return if it is within the cap, else null."""
    return F.when(F.abs(F.col(r)) <= (F.col(cap) if isinstance(cap, str) else F.lit(cap)), F.col(r))


def normal_code(code: Column) -> Column:
    """Code without leading A's, filled with zeros to six places; longer codes stay whole."""
    bare = F.regexp_replace(code, "^A+", "")
    return F.when(F.length(bare) < 6, F.lpad(bare, 6, "0")).otherwise(bare)


def from_percent(value: Column, mark: Column, sentinels: list[float]) -> Column:
    """Value over 100, null where the mark is a sentinel."""
    return F.when(~mark.isin(sentinels), value / 100)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def zero_in(month: str, value: Column, spans: list[tuple[str, str]]) -> Column:
    """The value, 0 within the closed spans of months."""
    inside = F.lit(False)
    for a, b in spans:
        inside = inside | F.col(month).between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return F.when(inside, F.lit(0.0)).otherwise(value)


def columns_named(df: DataFrame, prefix: str = "", within: str = "", without: list[str] | None = None) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and within in c and c not in (without or [])]


def drop_all_null(df: DataFrame) -> DataFrame:
    """The frame without columns that hold no value; one pass counts all columns."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(str(k)) for k, c in enumerate(df.columns))).first()
    return df.select(*(F.col(f"`{c}`") for k, c in enumerate(df.columns) if counts[k]))


def report(long: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A (row, column, value) table as one row a metric; for sinks only."""
    return long.groupBy(row).pivot(column, values).agg(F.first("value"))


def segments(df: DataFrame, month: str, spans: list[tuple[str, str, str]]) -> DataFrame:
    """Rows of each named closed span; spans may overlap. The spans are a literal array, not a table."""
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in spans))
    inside = F.filter(each, lambda s: F.col(month).between(s["a"], s["b"]))
    return df.withColumn("_s", F.explode(inside)).withColumn("name", F.col("_s.name")).drop("_s")


def as_of(left: DataFrame, right: DataFrame, key: str, found: str, by: list[str] | None = None) -> DataFrame:
    """Latest right value at or before each left key, by one window over both: no range join."""
    by = by or []
    both = left.select(*by, F.col(key).alias("_at"), F.lit(None).cast(right.schema[found].dataType).alias(found), F.lit(1).alias("_left")).unionByName(right.select(*by, F.col(found).alias("_at"), found, F.lit(0).alias("_left")))
    w = W.partitionBy(*by).orderBy("_at", "_left").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(found, F.last(found, ignorenulls=True).over(w)).where("_left = 1").select(*by, F.col("_at").alias(key), found)


def grid(keys: DataFrame, length: DataFrame, ordinal: str, start: Column | None = None, stop: Column | None = None) -> DataFrame:
    """Each row of `keys` for every ordinal of a calendar, from `start` to `stop`; `length` has one row with the calendar's last ordinal, _n."""
    own = keys.join(F.broadcast(length))
    first, last = F.lit(1) if start is None else start, F.col("_n") if stop is None else stop
    return own.withColumn(ordinal, F.explode(F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))))).drop("_n")


def aligned(panel: DataFrame, calendar: DataFrame, by: str, ordinal: str) -> DataFrame:
    """The panel (by, ordinal, ...) on its whole calendar: every key has a row at every ordinal, with nulls where it had none."""
    n = calendar.agg(F.max(ordinal).alias("_n"))
    return grid(panel.select(by).distinct(), n, ordinal).join(calendar, ordinal).join(panel, [by, ordinal], "left")


def carried(panel: DataFrame, calendar: DataFrame, by: str, ordinal: str, value: str) -> DataFrame:
    """The panel on its whole calendar, each key's last value that is not null carried on: by, ordinal and value.

    A value is repeated up to the key's next one, so the filled rows are made by no window.
    """
    n = calendar.agg(F.max(ordinal).alias("_n"))
    held = panel.where(F.col(value).isNotNull()).select(by, value, F.col(ordinal).alias("_from"))
    spans = held.withColumn("_to", F.lead("_from").over(W.partitionBy(by).orderBy("_from")) - 1)
    filled = grid(spans, n, ordinal, F.col("_from"), F.coalesce("_to", "_n")).select(by, ordinal, value)
    firsts = panel.select(by).distinct().join(held.groupBy(by).agg((F.min("_from") - 1).alias("_to")), by, "left")
    empty = grid(firsts, n, ordinal, None, F.coalesce("_to", "_n")).select(by, ordinal, F.lit(None).cast(panel.schema[value].dataType).alias(value))
    return filled.unionByName(empty)
