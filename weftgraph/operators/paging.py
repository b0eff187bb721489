"""Pages at any depth: a rank index of ordered ranges.

Rows are dealt to ranges of their order and written once, a folder a range; how many rows lie before each range
is a table of a row a range. A page is then read from the one or two ranges that hold it, and nothing else is
sorted, whatever its offset. Ranges are as even as the keys allow: rows with equal keys share one.

Defined cases: nulls come first, as in Spark's order; rows whose keys are all equal have no order among
themselves, so keys should tell rows apart; a page beyond the last row is empty; an empty table has no pages.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import shared_folder
from ..helpers import free_name


@dataclass(frozen=True)
class RankIndex:
    """The rows in their ranges, by which columns they are ordered, and (range, rows before, rows) of each in order."""

    rows: DataFrame
    order: tuple[str, ...]
    range_column: str
    ranges: tuple[tuple[int, int, int], ...]

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.ranges)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """The rows from `offset` on, with total and whether more follow."""
        held = [(p, before) for p, before, n in self.ranges if before < offset + limit and before + n > offset]
        rows = self.rows.filter(F.col(self.range_column).isin([p for p, _ in held]))
        skipped = offset - held[0][1] if held else 0
        rows = rows.orderBy(*self.order).offset(skipped).limit(limit).drop(self.range_column)
        return rows.withColumn("total", F.lit(self.total).cast("long")).withColumn("has_more", F.lit(offset + limit < self.total))


def rank_index(df: DataFrame, order: list[str], ranges: int) -> RankIndex:
    """df's rows in `ranges` ranges of an ascending order, written to the shared folder."""
    spark = df.sparkSession
    folder, name = f"{shared_folder(spark)}/rank-index-{uuid.uuid4().hex}", free_name(df, "range")
    df.repartitionByRange(ranges, *order).withColumn(name, F.spark_partition_id()).write.partitionBy(name).parquet(folder)
    rows = spark.read.schema(T.StructType([*df.schema.fields]).add(name, T.IntegerType())).parquet(folder)
    found, before = [], 0
    for r in rows.groupBy(name).agg(F.count("*").alias("n")).orderBy(name).collect():  # a row a range; the number of ranges is given
        found.append((r[name], before, r["n"]))
        before += r["n"]
    return RankIndex(rows, tuple(order), name, tuple(found))
