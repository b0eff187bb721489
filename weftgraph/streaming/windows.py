"""Hopping windows with late rows kept: what the watermark leaves out is counted beside, not lost.

A batch's watermark is the latest time of the batches before it less the lateness. A row counts in those of its windows
that end after it; for the windows that have ended it is late, and is counted there. Each batch
writes its partial counts once (`BatchTables`); sums over batches are the windows, and windows plus late
rows are what a batch job over all rows would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import BatchTables


def hopping(events: DataFrame, by: list[str], size: str, slide: str, lateness: str = "1 hour") -> DataFrame:
    """Counts of each window of `size` every `slide`, by some columns, as a plain stream: rows behind the watermark are dropped."""
    w = events.withWatermark("at", lateness).groupBy(F.window("at", size, slide).alias("w"), *by)
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


class HoppingWindows:
    """Writes the batches of a stream of events (at, columns `by` of type string) as counts of windows, and late ones beside."""

    def __init__(self, tables: BatchTables, by: list[str], size: str, slide: str, lateness: str = "1 hour"):
        self.tables, self.by, self.size, self.slide, self.lateness = tables, by, size, slide, lateness
        self.schema = "start timestamp, end timestamp, " + "".join(f"`{c}` string, " for c in by) + "n long"

    def counted(self, rows: DataFrame) -> DataFrame:
        w = rows.groupBy(F.window("at", self.size, self.slide).alias("w"), *[F.col(c).cast("string").alias(c) for c in self.by])
        return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *self.by, "n")

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        rows = rows.filter("at IS NOT NULL")
        mark = self.tables.marks("latest timestamp", batch_id).agg(F.max("latest").alias("latest")).select((F.col("latest") - F.expr(f"INTERVAL {self.lateness}")).alias("mark"))
        windows = self.counted(rows).crossJoin(F.broadcast(mark))  # one row
        late = F.coalesce(F.col("end") <= F.col("mark"), F.lit(False))
        self.tables.commit(batch_id, {"windows": windows.filter(~late).drop("mark"), "late": windows.filter(late).drop("mark")}, rows.agg(F.max("at").alias("latest")))

    def result(self, name: str = "windows") -> DataFrame:
        """Sums of what finished batches counted: `windows`, or `late`."""
        return self.tables.table(name, self.schema).groupBy("start", "end", *self.by).agg(F.sum("n").alias("n"))
