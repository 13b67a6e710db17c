"""Best value so far and stall counter of each key over a log of attempts, with keyed state and timers.

Attempts wait in state until the watermark has passed their time, so late ones still take their place;
a timer then takes them in order. A key that has stalled for long enough keeps only that it has stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Patience(StatefulProcessor):
    def __init__(self, patience: int, key: str):
        self.patience, self.key = patience, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "attempt long, best double, stalled long, stopped boolean")
        self.waiting = handle.getListState("waiting", "at long, place long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not (self.progress.exists() and self.progress.get()[3]):
            fresh = [(int(r.at), int(r.place), None if pd.isna(r.value) else float(r.value)) for part in rows for r in part.itertuples(index=False)]
            known = {t.expiryTimeMs if hasattr(t, "expiryTimeMs") else t for t in self.handle.listTimers()}
            first = min(at for at, _, _ in fresh) // 1000 + 1
            self.waiting.appendList(fresh)
            if not known or first < min(known):
                self.handle.registerTimer(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        attempt, best, stalled, stopped = self.progress.get() if self.progress.exists() else (0, None, 0, False)
        out, later = [], [tuple(r) for r in held if r[0] >= upto]
        for at, _, value in held:
            if at >= upto or stopped:
                break
            attempt += 1
            if value is not None and (best is None or value < best):
                best, stalled = value, 0
            elif value is not None:
                stalled += 1
            out.append((key[0], attempt, value, best, stalled))
            stopped = 0 < self.patience <= stalled
        self.progress.update((attempt, best, stalled, stopped))
        self.waiting.clear()
        if later and not stopped:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        yield pd.DataFrame(out, columns=[self.key, "attempt", "value", "best", "stalled"])

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which keyed state needs; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stalls(attempts: DataFrame, key: str, patience: int, delay: str) -> DataFrame:
    """(key, attempt, value, best, stalled) of a stream (key, ts, place, value); attempts go by ts, then place."""
    kept = attempts.withWatermark("ts", delay).selectExpr(key, "ts", "unix_micros(ts) as at", "place", "value")
    return kept.groupBy(key).transformWithStateInPandas(Patience(patience, key), f"{key} long, attempt long, value double, best double, stalled long", "Append", "EventTime")
