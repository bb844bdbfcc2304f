"""The streaming forms give the batch answer."""

from __future__ import annotations

import os
import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from factorloom.streaming import daily_risk, smoothed_state

DATA = "/root/testdata/sf0.001/events.parquet"


def run(query, name, mode="complete"):
    q = query.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return query.sparkSession.sql(f"SELECT * FROM {name}")


def test_tumbling_windows_match_the_batch(spark):
    batch = spark.read.parquet(DATA)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/events.parque[t]")
    key = lambda df: sorted((str(r.start), r.event_type, round(r.rv, 6), r.n) for r in df.collect())
    ours = lambda df: daily_risk.tumbling_variance(df.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")
    assert key(run(ours(stream), "tumbling")) == key(ours(batch))


def test_ring_buffer_matches_the_last_rows(spark, tmp_path):
    """Rows that arrive in any order: the last ones by time count."""
    schema = "user_id long, ts timestamp, value double"
    rows = [(u, datetime(2020, 1, 1) + timedelta(minutes=i), float(i % 7)) for i in range(300) for u in (1, 2)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = run(daily_risk.ring_variance(stream, "user_id", "ts", "value", size=50), "ring", "update").collect()
    want = 21 * sum(float(i % 7) ** 2 for i in range(250, 300)) / 50
    assert {r.user_id: round(r.variance, 9) for r in got} == {1: round(want, 9), 2: round(want, 9)}


def test_session_windows_match_the_batch(spark):
    batch = spark.read.parquet(DATA)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/events.parque[t]")
    key = lambda df: sorted((str(r.start), str(r.end), r.event_type, r.n) for r in df.collect())
    ours = lambda df: daily_risk.sessions(df.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    assert key(run(ours(stream), "sessions")) == key(ours(batch))


def test_sliding_windows_match_the_batch(spark):
    batch = spark.read.parquet(DATA)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/events.parque[t]")
    key = lambda df: sorted((str(r.start), r.event_type, round(r.rv, 6), r.n) for r in df.collect())
    ours = lambda df: daily_risk.sliding_variance(df.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")
    got = key(ours(batch))
    assert key(run(ours(stream), "sliding")) == got and sum(r[3] for r in got) == 2 * batch.count()


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    schema, start = "user_id long, ts timestamp, value double", datetime(2020, 1, 1)
    batches = [[(1, start, 1.0), (1, start + timedelta(minutes=90), 2.0)], [(1, start + timedelta(days=3), 3.0)], [(2, start + timedelta(days=3), 1.0)], [(1, start + timedelta(minutes=5), 50.0)], [(1, start + timedelta(days=9), 4.0)]]
    feed(spark, tmp_path, batches, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(daily_risk.tumbling_variance(stream, "ts", "user_id", "value"), "late_rows", "append").collect()
    assert {(r.user_id, r.start, r.rv, r.n) for r in got} == {(1, start, 5.0, 2), (1, start + timedelta(days=3), 9.0, 1), (2, start + timedelta(days=3), 1.0, 1)}


def feed(spark, folder, batches, schema):
    """One file a batch, in order of their times."""
    os.makedirs(folder / "in")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"out{k}"))
        part = next(p for p in os.listdir(folder / f"out{k}") if p.endswith(".parquet"))
        os.rename(folder / f"out{k}" / part, folder / "in" / f"{k}.parquet")
        os.utime(folder / "in" / f"{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))


def test_smoothed_state_with_timers(spark, tmp_path):
    """Rows in any order are folded by time, late rows never, and an idle key is forgotten and starts anew."""
    schema, start = "user_id long, ts timestamp, value double", datetime(2020, 1, 1)
    minute = lambda m: start + timedelta(minutes=m)
    own = [(1, minute(m), float(m % 5 - 2)) for m in range(20)]
    random.Random(2).shuffle(own)
    first, second = [r for r in own if r[1] < minute(12)], [r for r in own if r[1] >= minute(12)]
    second, first = [*second, first[0]], first[1:]  # one row comes out of order, but not late
    batches = [[*first, (2, minute(1), None), (3, None, 1.0)], second, [(9, minute(120), 1.0)], [(9, minute(121), 1.0)], [(1, minute(5), 100.0)], [(9, minute(1440), 1.0)], [(1, minute(1441), 3.0)], [(9, minute(2000), 1.0)]]
    feed(spark, tmp_path, batches, schema)
    before = spark.conf.get(smoothed_state.PROVIDER, None)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        rows = run(smoothed_state.smoothed_variance(stream, "user_id", "ts", "value", lam=0.9, idle_seconds=7200), "smoothed", "update").where("user_id = 1").collect()
    finally:
        spark.conf.unset(smoothed_state.PROVIDER) if before is None else spark.conf.set(smoothed_state.PROVIDER, before)
    level = None
    for m in range(20):
        v = float(m % 5 - 2)
        level = v * v if level is None else 0.9 * level + 0.1 * v * v
    folded = [r for r in rows if not r.expired]
    assert folded[-2].n == 20 and abs(folded[-2].variance - level) < 1e-12 and folded[-2]["at"] == minute(19)
    assert [(r.n, round(r.variance, 12)) for r in rows if r.expired] == [(20, round(level, 12))]
    assert (folded[-1].n, folded[-1].variance) == (1, 9.0)  # after it was forgotten
    assert not [r for r in rows if r.n > 20]
