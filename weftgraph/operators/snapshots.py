"""Comparing snapshots, carrying unchanged rows forward, and picking the latest row of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..helpers import free_name


def latest(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in an order. Spark turns the filter into a limit within groups before the shuffle."""
    row = free_name(df, "row")
    return df.withColumn(row, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(row) == 1).drop(row)


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files (path, hash) that are new or whose hash differs; all, if there is no snapshot before."""
    old = before.select("path", F.col("hash").alias("old"))
    return now.join(old, "path", "left").filter("old is null or old <> hash").select(*now.columns, F.when(F.col("old").isNull(), "new").otherwise("modified").alias("change"))


def carry_forward(previous: DataFrame, now: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of the previous snapshot (file_path) whose file is unchanged and still there; rows of no file stay.

    A deviation: rows of deleted files are dropped, and rows keep all their columns.
    """
    kept = now.select(F.col("path").alias("file_path")).join(changed.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    return previous.filter("file_path <> ''").join(kept, "file_path", "left_semi").select(*previous.columns).unionByName(previous.filter("file_path = ''"))


COMPARED = ("signature", "start_line", "end_line", "file_path")


def diff(base: DataFrame, head: DataFrame, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """(fq_name, kind, change): added, removed, modified and unchanged symbols. One full outer join."""
    side = lambda df, p: df.select("fq_name", F.struct("kind", *compared).alias(p))
    both = side(base, "b").join(side(head, "h"), "fq_name", "full")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"h.{c}"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return both.select("fq_name", F.coalesce("h.kind", "b.kind").alias("kind"), change.alias("change"))


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified", "unchanged")])
