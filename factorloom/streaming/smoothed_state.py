"""Exponentially smoothed squared values of each key as state of a stream, with timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Smoothing(StatefulProcessor):
    """Holds rows until the watermark has passed them, then folds them in by time; a key that stays idle is forgotten.

    The level starts at the first squared value and is lam times itself plus 1 - lam times each next one. So the order in
    which rows arrive changes nothing, as long as they are not late; late rows never reach the state.
    """

    def __init__(self, lam: float, idle_ms: int, key: str):
        self.lam, self.idle_ms, self.key = lam, idle_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "level double, last long, n long")
        self.held = handle.getListState("held", "at long, v double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = None
        for part in rows:
            part = part.dropna(subset=["at_us", "squared_of"])
            if len(part):
                self.held.appendList(list(zip(part["at_us"].astype("int64").tolist(), part["squared_of"].astype(float).tolist(), strict=True)))
                latest = max(latest or 0, int(part["at_us"].max()))
        if latest is not None:
            self.handle.registerTimer(-(-latest // 1000))  # microseconds to the millisecond at or after them
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = sorted(tuple(r) for r in self.held.get())
        due, later = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        level, last, n = tuple(self.level.get()) if self.level.exists() else (None, None, 0)
        for at, v in due:
            if last is not None and at - last >= self.idle_ms * 1000:  # it had been idle for so long
                level, n = None, 0
            level = v * v if level is None else self.lam * level + (1 - self.lam) * v * v
            last, n = at, n + 1
        if due:
            if later:
                self.held.put(later)
            else:
                self.held.clear()
            self.level.update((level, last, n))
            self.handle.registerTimer(-(-last // 1000) + self.idle_ms)
            yield self._shown(key, last, n, level, False)
        elif n and -(-last // 1000) + self.idle_ms <= now // 1000:
            self.level.clear()
            yield self._shown(key, last, n, level, True)

    def _shown(self, key: tuple, last: int, n: int, level: float, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "at": [pd.Timestamp(last, unit="us")], "n": [n], "variance": [level], "expired": [expired]})

    def close(self) -> None:
        pass


def smoothed_variance(stream: DataFrame, key: str, ts: str, value: str, lam: float = 0.94, late: str = "10 minutes", idle_seconds: int = 86_400) -> DataFrame:
    """Rows (key, at, n, variance, expired) each time a key's rows are folded in, and once when it has been idle for so long.

    Rows with a null time or value take no part. State lives in RocksDB, which value and list states need; the session is set so.
    """
    spark = stream.sparkSession
    spark.conf.set(PROVIDER, ROCKS)
    kind = dict(stream.dtypes)[key]
    # rows reach the processor as named tuples, in which names can't begin with an underscore
    timed = stream.where(F.col(ts).isNotNull()).select(key, F.col(ts).cast("timestamp").alias("event_time"), F.col(value).cast("double").alias("squared_of")).withColumn("at_us", F.unix_micros("event_time")).withWatermark("event_time", late)
    return timed.groupBy(key).transformWithStateInPandas(Smoothing(lam, idle_seconds * 1000, key), f"{key} {kind}, at timestamp, n long, variance double, expired boolean", "Update", "EventTime")
