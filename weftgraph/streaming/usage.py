"""Structured Streaming forms of the usage queries.

Each takes a streaming (or batch) DataFrame of events (user_id, action, tokens, at) and returns
one. Windows are closed by a watermark, so state is bounded by the lateness allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.usage import _bucket

LATENESS = "1 hour"


def daily_quota(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Tokens and actions of each user in one-day windows; rows later than the watermark are dropped."""
    w = events.withWatermark("at", lateness).groupBy(F.window("at", "1 day").alias("w"), "user_id")
    return w.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("actions")).select("user_id", F.col("w.start").cast("date").alias("period"), "tokens", "actions")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    w = events.withWatermark("at", lateness).groupBy(F.session_window("at", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("actions")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "actions")


def request_counts(requests: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Requests of each (route, status) in one-minute windows."""
    w = requests.withWatermark("at", lateness).groupBy(F.window("at", "1 minute").alias("w"), "route", "status")
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "route", "status", "n")


def rate_limited(requests: DataFrame, rate: float = 1.0, burst: int = 60) -> DataFrame:
    """requests (key, id, seconds) with `allowed`: a token bucket a key, kept as state between batches.

    Rows of one batch are taken in order of time and id.
    """
    fold = _bucket(rate, burst)

    class Adapter:
        def __init__(self, state):
            self.state = state
            self.exists = state.exists
            self.get = state.get if state.exists else None

        def update(self, value) -> None:
            self.state.update(value)

    def run(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        yield from fold(key, iter([pd.concat(list(rows))]), Adapter(state))

    return requests.groupBy("key").applyInPandasWithState(run, "key long, id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def events_stream(spark: SparkSession, folder: str, schema, files_each: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)
