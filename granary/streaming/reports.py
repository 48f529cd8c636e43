"""Reports of running totals at most once in a span of time, by timers of a stateful stream (STR-03)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that has timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Throttled(StatefulProcessor):
    """The running count and sum of a key, told at the first timer after new rows came; a key has one timer at most, ``every`` after its first untold row.

    The clock is the processing time, or the rows' own ``ts`` with the watermark.
    """

    def __init__(self, every: int, own_clock: bool):
        self.every, self.own_clock = every, own_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, total double, told long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total, told, due = self.sums.get() if self.sums.exists() else (0, 0.0, 0, 0)
        first = None
        for frame in rows:
            n += int(frame["counted"].sum())
            total += float(frame["size"].sum())
            if self.own_clock and len(frame):
                least = int(frame["ms"].min())
                first = least if first is None else min(first, least)
        if not due and n > told:
            due = (first if self.own_clock else timerValues.getCurrentProcessingTimeInMs()) + self.every
            self.handle.registerTimer(due)
        self.sums.update((n, total, told, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, total, told, _ = self.sums.get()
        self.sums.update((n, total, n, 0))
        if n > told:
            yield pd.DataFrame({"key": [key[0]], "n": [n], "total": [total], "ms": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def throttled(rows: DataFrame, key: str, size: str, every: float = 30.0, ts: str | None = None, late: str = "0 seconds") -> DataFrame:
    """key, n, total, at: a stream's running count and sum of ``size`` by ``key``, told ``every`` so many seconds at most for each key, and only if rows came since.

    Without ``ts`` the clock is the processing time. With it, it is that column and its watermark (``late``): a report is due when the watermark passes, and
    rows that are later than it are left out, as in any windowed count. Null sizes count as rows of 0; a null key is a key. The sum of a key is what its last report says.
    The state (a few numbers for each key) is in the session's state store, which must have timers: see ``STORE``.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    if ts is not None:
        rows = rows.withWatermark(ts, late)
        rows = rows.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.lit(1).alias("counted"), F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("size"), F.unix_millis(F.col(ts)).alias("ms"))
    else:
        rows = rows.select(F.col(key).cast("string").alias("key"), F.lit(1).alias("counted"), F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("size"))
    out = rows.groupBy("key").transformWithStateInPandas(Throttled(int(every * 1000), ts is not None), "key string, n long, total double, ms long", "Update", "ProcessingTime" if ts is None else "EventTime")
    return out.select("key", "n", "total", F.timestamp_millis("ms").alias("at"))
