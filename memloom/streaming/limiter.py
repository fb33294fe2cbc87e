"""A token bucket for each key, over a stream or over stored events."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Task functions travel with the job, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OUT = "key string, at timestamp_ntz, id long, allowed boolean, tokens double"


def take(tokens: float, last: float | None, now: float, rate: float, burst: float) -> tuple[float, bool]:
    """The tokens left and whether one was there: the bucket refills with time up to ``burst``."""
    if last is not None:
        tokens = min(burst, tokens + max(0.0, now - last) * rate)
    return (tokens - 1.0, True) if tokens >= 1.0 else (tokens, False)


def limited(events: DataFrame, key: str, at: str, id: str, rate: float, burst: float) -> DataFrame:
    """Stored events in order of time, each with whether it is let through.

    Rows are dealt by key and sorted in Spark; a task streams them and holds one bucket, so a
    key with any number of events needs no memory.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp_ntz").alias("at"), F.col(id).cast("long").alias("id"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, last = None, burst, None
        for batch in batches:
            seconds = batch["at"].astype("datetime64[us]").astype("int64") / 1e6
            allowed, left = [], []
            for k, now in zip(batch["key"], seconds, strict=True):
                if k != current:
                    current, tokens, last = k, burst, None
                tokens, ok = take(tokens, last, now, rate, burst)
                last = now
                allowed.append(ok)
                left.append(tokens)
            yield batch.assign(allowed=allowed, tokens=left)

    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(walk, _OUT)


class Buckets(StatefulProcessor):
    """The bucket of each key. It is dropped once it must be full again, which is what a new one is."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tokens, last = self.bucket.get() if self.bucket.exists() else (self.burst, None)
        for batch in rows:
            batch = batch.sort_values(["at", "id"])
            allowed, left = [], []
            for now in batch["at"].astype("datetime64[us]").astype("int64") / 1e6:
                tokens, ok = take(tokens, last, now, self.rate, self.burst)
                last = max(now, last or now)
                allowed.append(ok)
                left.append(tokens)
            yield pd.DataFrame({"key": batch["key"], "at": batch["at"], "id": batch["id"], "allowed": allowed, "tokens": left})
        self.bucket.update((tokens, last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        full = last + (self.burst - tokens) / self.rate
        self.handle.registerTimer(max(int(full * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.bucket.clear()
        yield from ()

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, rate: float, burst: float, lateness: str = "1 hour") -> DataFrame:
    """The same over a stream of ``key, at, id``; ``at`` is a timestamp.

    The bucket of a key is kept as state until the watermark shows that it is full again: a key
    without one begins with a full bucket, so no decision changes and idle keys cost nothing.
    Events later than ``lateness`` are dropped. Needs the RocksDB state store.
    """
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id"))
    out = _OUT.replace("at timestamp_ntz", "at timestamp")
    return rows.withWatermark("at", lateness).groupBy("key").transformWithStateInPandas(Buckets(rate, burst), out, "append", "eventTime")
