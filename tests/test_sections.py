"""Library text files and Markdown lines: splits, runs, sentinels, order."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factorloom.sources import files, sections


def read(spark, tmp_path, text, title="Mine -- Daily", names=("a", "b"), name="x.csv"):
    (tmp_path / name).write_text(text)
    return {(str(r.date), r.name): r.value for r in sections.read(spark, [f"file://{tmp_path}"], title, list(names)).collect()}


def test_section_is_one_run_after_its_title(spark, tmp_path):
    text = "prose\n19990104,9,9\n\nOther -- Daily\n,a,b\n19990104,8,8\n\n Mine -- Daily \n,a,b\n\n19990104, 1.5,-99.99\n19990105,-999,no number\n19990106,2\n\n19990107,7,7\nCopyright\n"
    got = read(spark, tmp_path, text)
    assert got == {("1999-01-04", "a"): 0.015, ("1999-01-04", "b"): None, ("1999-01-05", "a"): None, ("1999-01-05", "b"): None, ("1999-01-06", "a"): 0.02, ("1999-01-06", "b"): None}


def test_title_right_after_data_and_twice_in_a_file(spark, tmp_path):
    text = "Other\n,a\n199901,5\nMine\n,a\n199901,1\n199902,2\nThird\n,a\n199903,6\nMine\n,a\n199904,4\n"
    got = read(spark, tmp_path, text, "Mine", ["a"])
    assert got == {("1999-01-31", "a"): 0.01, ("1999-02-28", "a"): 0.02, ("1999-04-30", "a"): 0.04}


def test_files_without_the_title_or_without_lines_give_nothing(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert read(spark, tmp_path, "prose\n199901,1\n", "Mine", ["a"]) == {}


def test_sections_over_many_splits_of_a_file(spark, tmp_path):
    """A file cut into some fifty splits: data, titles and breaks fall on both sides of the cuts."""
    first = dt.date(1970, 1, 1)
    dated = lambda n, value: [f"{first + dt.timedelta(i):%Y%m%d},{value(i):.4f}" for i in range(n)]
    lines = ["Other", ",a", *dated(2000, lambda i: 7), "", "Mine", ",a", *dated(3000, lambda i: i / 100), "", *dated(500, lambda i: 3), "Last", ",a", *dated(1500, lambda i: 5)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
        assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 20
        got = {(str(r.date)): r.value for r in sections.read(spark, [f"file://{tmp_path}"], "Mine", ["a"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 3000
    assert all(got[str(first + dt.timedelta(i))] == pytest.approx(i / 1e4) for i in range(3000))


def test_written_files_hold_their_sections_in_order(spark):
    days = [(y, s, dt.date(y, m, 1), 8 if s == "A" else 6, m / 100) for y in (1999, 2000) for s in ("A", "B") for m in (3, 1, 2)]
    path = sections.write(spark.createDataFrame(days, "year int, section string, date date, digits int, v double"), "year", "section", "date", "digits", ["v"])
    texts = spark.read.text(path, wholetext=True).where("file = 1999").collect()
    assert len(texts) == 1
    assert texts[0].value == "This file was made for a test.\n\nA\n,v\n19990101,1.0000000000\n19990201,2.0000000000\n19990301,3.0000000000\n\nB\n,v\n199901,1.0000000000\n199902,2.0000000000\n199903,3.0000000000\n\n"


def test_markdown_lines(spark):
    df = spark.createDataFrame([("b", None, 2), ("a|c", 1.23456, None), (None, -0.5, 1)], "name string, x double, n int")
    got = [r.line for r in files.markdown_lines(df, ["name"], 2).orderBy("at").collect()]
    assert got == ["| name | x | n |", "| --- | --- | --- |", "|  | -0.50 | 1 |", "| a\\|c | 1.23 |  |", "| b |  | 2 |"]
    assert files.markdown_lines(df.limit(0), ["name"]).count() == 2


def test_rows_are_numbered_over_many_ranges(spark):
    n = 200_000
    df = spark.range(n).select(F.xxhash64("id").alias("key"))
    got = files.numbered(df, ["key"], "at")
    after = got.selectExpr("count(distinct at) AS d", "min(at) AS a", "max(at) AS b").first()
    assert (after.d, after.a, after.b) == (n, 0, n - 1)
    ours, sorted_ = [r.key for r in got.orderBy("at").collect()], sorted(r.key for r in df.collect())
    assert ours == sorted_
