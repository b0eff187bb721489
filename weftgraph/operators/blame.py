"""Line authorship joined to symbols, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of one join bucket: an equi-join on (file, bucket) keeps very long files from one task.
BUCKET = 256


def by_symbol(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(fq_name, author_count, commit_count, last_author, last_modified_at) of symbols with blamed lines.

    An interval join: symbols are dealt to the line buckets that they span, lines to their own.
    The last author is that of the latest commit, on a tie of the first line.
    """
    spans = symbols.filter("end_line >= start_line").select("fq_name", "file_path", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / BUCKET), F.floor(F.col("end_line") / BUCKET))).alias("bucket"))
    dealt = lines.withColumn("bucket", F.floor(F.col("line_no") / BUCKET))
    hit = spans.join(dealt, ["file_path", "bucket"]).filter("line_no between start_line and end_line")
    latest = F.struct("committed_at", -F.col("line_no"))
    return hit.groupBy("fq_name").agg(F.count_distinct("author").alias("author_count"), F.count_distinct("commit").alias("commit_count"), F.max_by("author", latest).alias("last_author"), F.max("committed_at").alias("last_modified_at"))
