"""Readers and writers: CSV, Parquet, wide sheets, sectioned text, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.sources import sections
from factorloom.sources.shared import new_path, written


def csv_round_trip(df: DataFrame) -> DataFrame:
    """Write as CSV with a header and read back under the same schema."""
    path = new_path(df.sparkSession)
    df.write.option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def parquet_round_trip(df: DataFrame) -> DataFrame:
    return written(df)


def unpivot_sheet(wide: DataFrame, code: str, date: str, value: str) -> DataFrame:
    """A sheet with a column a date to long rows of positive numbers, stamped by month end."""
    days = [c for c in wide.columns if c != code]
    long = wide.select(code, *(F.col(f"`{c}`").cast("string").alias(c) for c in days)).unpivot(code, days, date, value)
    return long.select(code, F.last_day(F.to_date(date)).alias(date), F.expr(f"try_cast({value} as double)").alias(value)).where(F.col(value) > 0)


def write_sectioned(df: DataFrame, title: str) -> DataFrame:
    """Text files, one a year, with prose, another section and one titled section of dated rows in percent; returns (path)."""
    cols = [c for c in df.columns if c != "date"]
    year = F.year("date").alias("year")
    daily = df.select(year, F.lit(title).alias("section"), "date", F.lit(8).alias("digits"), *cols)
    other = df.select(year, F.lit("Other Returns -- Monthly").alias("section"), F.last_day("date").alias("date"), F.lit(6).alias("digits"), *(F.lit(0.01).alias(c) for c in cols)).distinct()
    path = sections.write(daily.unionByName(other), "year", "section", "date", "digits", cols)
    return df.sparkSession.createDataFrame([(path,)], "path string")


def sectioned(paths: DataFrame, title: str, names: list[str]) -> DataFrame:
    """Rows of the titled section of each file or folder: date, name, value (fraction; sentinels are null)."""
    return sections.read(paths.sparkSession, [r.path for r in paths.collect()], title, names)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows from 0 in an order that names every row: inside ranges of the sorted table, after the rows of the ranges before.

    The ranges are written first, as a repeated task may not deal its rows anew; the running sum is over one row a range.
    """
    placed = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return placed.withColumn("_in", inside).join(starts, "_range").withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop("_range", "_in", "_start")


def markdown_lines(df: DataFrame, order: list[str], digits: int = 4) -> DataFrame:
    """A table of any length as the lines of a Markdown table: at (0 and 1: head and rule; then one a row in the order), line.

    A null is an empty cell, a floating-point number has `digits` decimals, bars inside a text are escaped.
    """
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        number = kinds[c] in ("double", "float")
        text = F.format_string(f"%.{digits}f", F.col(c).cast("double")) if number else F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|"))
        return F.when(F.col(c).isNotNull(), text).otherwise("")

    bars = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = numbered(df, order, "_at").select((F.col("_at") + 2).alias("at"), bars([cell(c) for c in df.columns]).alias("line"))
    head = [(0, f"| {' | '.join(df.columns)} |"), (1, f"| {' | '.join('---' for _ in df.columns)} |")]
    return rows.unionByName(df.sparkSession.createDataFrame(head, "at long, line string"))


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A small result table as Markdown text."""
    show = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    rows = [df.columns, ["---"] * len(df.columns), *([show(x) for x in r] for r in df.collect())]
    return "\n".join(f"| {' | '.join(r)} |" for r in rows) + "\n"


def compared(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Greatest absolute difference of two series on their common keys."""
    return ours.join(theirs.withColumnRenamed(value, "_theirs"), keys).agg(F.max(F.abs(F.col(value) - F.col("_theirs"))).alias("difference"))
