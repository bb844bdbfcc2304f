"""Streaming forms: tumbling, sliding and session windows with a watermark, and a keyed ring buffer of returns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RING = 126


def tumbling_variance(events: DataFrame, ts: str, key: str, value: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Sum of squares and count by key and window; rows later than the watermark are dropped. The same for batches."""
    base = events.withWatermark(ts, late) if events.isStreaming else events
    g = base.groupBy(F.window(ts, width).alias("w"), key)
    return g.agg(F.sum(F.col(value) * F.col(value)).alias("rv"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "rv", "n")


def sliding_variance(events: DataFrame, ts: str, key: str, value: str, width: str = "2 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The same over windows that overlap: one starts with every `slide`."""
    base = events.withWatermark(ts, late) if events.isStreaming else events
    g = base.groupBy(F.window(ts, width, slide).alias("w"), key)
    return g.agg(F.sum(F.col(value) * F.col(value)).alias("rv"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "rv", "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    base = events.withWatermark(ts, late) if events.isStreaming else events
    return base.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def ring_variance(stream: DataFrame, key: str, ts: str, value: str, size: int = RING) -> DataFrame:
    """21 times the mean square of each key's last `size` values by time, kept as state between batches.

    Rows may arrive in any order: a late row takes its place by time, or none if `size` later ones are held.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, held = (list(x) for x in state.get) if state.exists else ([], [])
        for f in frames:
            pairs = sorted(zip(at + f["_at"].tolist(), held + f[value].tolist(), strict=True))[-size:]
            at, held = [t for t, _ in pairs], [v for _, v in pairs]
        state.update((at, held))
        yield pd.DataFrame({key: [k[0]], "n": [len(held)], "variance": [21 * sum(v * v for v in held) / len(held) if len(held) == size else None]})

    kind = dict(stream.dtypes)[key]
    timed = stream.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), value)
    return timed.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, variance double", "at array<long>, held array<double>", "update", GroupStateTimeout.NoTimeout)
