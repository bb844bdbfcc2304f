"""Factor-library text files: prose, then titled sections of dated rows in percent.

Both directions work by lines, so neither a file nor a section has to fit into a row. A library is written as one file a key
(a year, say) by the task that its sorted lines reach; it is read in splits, and what a line belongs to comes from two levels:
running values inside a split, and those of the splits before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.sources.shared import new_path

#: Marks of missing values in percent files.
SENTINELS = [-99.99, -999.0]

#: A row of a section: a month of six or a day of eight digits, then values.
DATED = r"^\s*\d{6}(\d{2})?\s*,"


def write(df: DataFrame, key: str, section: str, date: str, digits: str, columns: list[str], preface: list[str] = ("This file was made for a test.", "")) -> str:
    """Write rows (key, section, date, digits, columns) as one text file a key and give the folder's path.

    `digits` is 8 for days and 6 for months. Sections stand in the order of their titles, each under its title and a line of
    names, followed by an empty line; a null is the first sentinel. Values are fractions in the table and percent in the file.
    """
    cells = [F.coalesce(F.format_string("%.10f", F.col(c) * 100), F.lit("-99.99")) for c in columns]
    stamp = F.when(F.col(digits) == 8, F.date_format(date, "yyyyMMdd")).otherwise(F.date_format(date, "yyyyMM"))
    line = lambda *parts: F.array(*(F.struct(F.lit(i).alias("at"), p.alias("value")) for i, p in parts))
    rows = df.select(F.col(key).alias("file"), F.col(section).alias("section"), F.lit(2).alias("at"), F.col(date).alias("date"), F.concat_ws(",", stamp, *cells).alias("value"))
    heads = df.select(F.col(key).alias("file"), F.col(section).alias("section")).distinct()
    around = heads.withColumn("l", F.explode(line((0, F.col("section")), (1, F.lit(",".join(["", *columns]))), (3, F.lit("")))))
    around = around.select("file", "section", "l.at", F.lit(None).cast("date").alias("date"), "l.value")
    first = heads.select("file").distinct().withColumn("value", F.explode(F.array(F.lit("\n".join(preface))))).select("file", F.lit("").alias("section"), F.lit(0).alias("at"), F.lit(None).cast("date").alias("date"), "value")
    path = new_path(df.sparkSession)
    lines = rows.unionByName(around).unionByName(first).repartition("file").sortWithinPartitions("file", "section", "at", "date")
    lines.select("file", "value").write.partitionBy("file").text(path)
    return path


def _carried(x: DataFrame, name: str, of_block: Column, before: Column) -> DataFrame:
    """Column `name`: `before` of the blocks that lie ahead of a line's block in its file, from one value a block."""
    totals = x.groupBy("file", "block").agg(of_block.alias("_of"))
    past = totals.select("file", "block", before.over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias(name))
    return x.join(past, ["file", "block"])


def read(spark: SparkSession, paths: list[str], title: str, names: list[str]) -> DataFrame:
    """Rows of the titled section of each file: date, name, value (a fraction; sentinels and what is no number are null).

    The section is the run of dated rows after its title: it begins with the first of them and ends before the next line that is
    not dated. Months are dated by their last day. Files without the title, and empty ones, give no rows; a title that stands
    several times in a file gives each of its runs; missing cells are null.
    """
    text = spark.read.option("recursiveFileLookup", True).text(paths)
    x = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    x = x.withColumns({"dated": F.col("value").rlike(DATED), "head": F.trim("value") == title})
    inside = W.partitionBy("file", "block").orderBy("at")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    place = F.struct("block", "at")
    x = _carried(x, "ahead", F.max_by("dated", "at"), F.last("_of"))
    x = x.withColumn("before", F.coalesce(F.lag("dated").over(inside), F.col("ahead"), F.lit(False)))
    x = x.withColumns({"begins": F.when(F.col("head"), place), "ends": F.when(~F.col("dated") & F.col("before"), place)})
    for mark in ("begins", "ends"):
        x = _carried(x, f"{mark}_ahead", F.max(mark), F.max("_of"))
        x = x.withColumn(mark, F.coalesce(F.max(mark).over(upto), F.col(f"{mark}_ahead")))
    rows = x.where(F.col("dated") & F.col("begins").isNotNull() & (F.col("ends").isNull() | (F.col("begins") >= F.col("ends"))))
    part = F.split("value", ",")
    day = F.trim(part[0])
    date = F.when(F.length(day) == 8, F.to_date(day, "yyyyMMdd")).otherwise(F.last_day(F.to_date(F.concat(day, F.lit("01")), "yyyyMMdd")))
    cells = F.array(*(F.struct(F.lit(n).alias("name"), F.trim(F.get(part, F.lit(i + 1))).alias("raw")) for i, n in enumerate(names)))
    out = rows.select(date.alias("date"), F.explode(cells).alias("c")).select("date", "c.name", F.expr("try_cast(c.raw as double)").alias("x"))
    return out.select("date", "name", F.when(~F.col("x").isin(SENTINELS), F.col("x") / 100).alias("value"))
