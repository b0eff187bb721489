"""Tables that a stream's batches write exactly once.

A batch overwrites its own folders, in an order that ends with its mark. What has no mark does not count, so a batch
that fails half-way and is run again, or that is replayed after a restart, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = "marks"


class BatchTables:
    """Tables under a folder that the cluster shares; each has a folder a batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commit(self, batch_id: int, frames: dict[str, DataFrame], mark: DataFrame | None = None) -> None:
        """Write all frames of a batch, then its mark (one row; its columns are the caller's)."""
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")
        (mark if mark is not None else self.spark.range(1).withColumnRenamed("id", "done")).write.mode("overwrite").parquet(f"{self.folder}/{MARKS}/batch={batch_id}")

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def marks(self, schema: str = "", before: int | None = None) -> DataFrame:
        """Marks of finished batches, or of those before one."""
        schema = ", ".join(x for x in (schema, "batch long") if x)
        if not self._there(MARKS):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(f"{self.folder}/{MARKS}")
        return df if before is None else df.filter(F.col("batch") < before)

    def table(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """Rows of finished batches with their `batch`."""
        schema = f"{schema}, batch long"
        if not self._there(name):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return rows.join(F.broadcast(self.marks(before=before).select("batch").distinct()), "batch", "left_semi")  # a row a batch

    def run(self, stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], **options):
        """The stream's batches through `each` (frame, batch id), started; `availableNow` unless options name a trigger."""
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
