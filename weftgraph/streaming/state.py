"""Keyed state that does not grow for ever: rate limits and last durations, with event-time timers.

Both need the RocksDB state store (`use_rocksdb`) and streams with a timestamp column `at` and a
watermark. State goes when the watermark passes the time until which it can matter: a bucket that
has had time to fill up again is the same as none, so nothing changes by forgetting it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LATENESS = "1 minute"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _seconds(at: pd.Series) -> np.ndarray:
    return at.to_numpy("datetime64[us]").astype(np.int64) / 1e6


def _wait(handle, until: float) -> None:
    """One timer a key, at `until` seconds: later ones take the place of earlier ones."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    handle.registerTimer(int(np.ceil(until * 1000)))


class TokenBucket(StatefulProcessor):
    """Tokens left and the last request of a key, until the bucket would be full."""

    def __init__(self, rate: float, burst: int):
        self.rate, self.burst = rate, burst

    def init(self, handle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["at", "id"])
        tokens, last = self.bucket.get() if self.bucket.exists() else (float(self.burst), None)
        allowed = []
        for now in _seconds(rows["at"]):
            tokens = min(float(self.burst), tokens + (0.0 if last is None else max(0.0, now - last)) * self.rate)
            allowed.append(tokens >= 1.0)
            tokens -= float(allowed[-1])
            last = float(now)
        self.bucket.update((tokens, last))
        _wait(self.handle, last + (self.burst - tokens) / self.rate)
        yield pd.DataFrame({"key": key[0], "id": rows["id"].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, rate: float = 1.0, burst: int = 60, lateness: str = LATENESS) -> DataFrame:
    """requests (key, id, at) with `allowed`: a token bucket a key. Rows of one batch are taken in order of time and id."""
    rows = requests.select("key", "id", "at").withWatermark("at", lateness)
    schema = requests.select("key", "id").schema.add("allowed", "boolean")
    return rows.groupBy("key").transformWithStateInPandas(TokenBucket(rate, burst), schema, "Append", "EventTime")


class LastDurations(StatefulProcessor):
    """The last durations of a route, in order of time and id, until the route has been quiet for a while."""

    def __init__(self, last: int, quiet: float):
        self.last, self.quiet = last, quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "at double, id long, duration double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        ring = [*(tuple(r) for r in self.ring.get()), *zip(_seconds(new["at"]).tolist(), new["id"].tolist(), new["duration"].tolist())]
        ring = sorted(ring)[-self.last :]
        self.ring.put(ring)
        _wait(self.handle, ring[-1][0] + self.quiet)
        d = sorted(x[2] for x in ring)
        yield pd.DataFrame({"route": [key[0]], "n": [len(d)], "total": [round(sum(d), 4)], "p50": [d[int(len(d) * 0.5)]], "p99": [d[int(len(d) * 0.99)]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        return iter([])

    def close(self) -> None:
        pass


def last_durations(requests: DataFrame, last: int = 1000, quiet: float = 86400.0, lateness: str = LATENESS) -> DataFrame:
    """requests (route, at, id, duration): after each batch the figures of `usage.latencies` of the routes it touched, over their last ones."""
    rows = requests.select("route", "at", F.col("id").cast("long").alias("id"), F.col("duration").cast("double").alias("duration")).withWatermark("at", lateness)
    return rows.groupBy("route").transformWithStateInPandas(LastDurations(last, quiet), "route string, n long, total double, p50 double, p99 double", "Update", "EventTime")
