"""Places for a user's own parts: heuristics, embedders, vector stores and summarisers.

A heuristic is a table function over the lines of diffs: Spark deals the lines by (diff_id, path) and
orders them, so a heuristic sees a file's lines one after the other and keeps what it likes of them. An
embedder is a function of a batch of texts. Both can be called from SQL once they are registered. A
vector store and a summariser have an interface, and one form each that Spark's own tables and columns give.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .graph import CodeGraph
from .operators import metrics, similarity, store
from .operators.facts import module_facts

#: Columns that a heuristic reads of the lines, and those of a finding.
LINE = ("diff_id", "path", "hunk_no", "pos", "side", "number", "old_number", "content")
FINDING = [T.StructField(n, t) for n, t in (("path", T.StringType()), ("line", T.IntegerType()), ("category", T.StringType()), ("severity", T.StringType()), ("label", T.StringType()))]

# ---- heuristics ---------------------------------------------------------------------------------


class Heuristic:
    """What a user extends: `line` is given every line of a file in order, `end` comes after the last. Both yield (line, severity, label)."""

    category = "custom"

    def line(self, row) -> Iterator[tuple]:
        return iter(())

    def end(self) -> Iterator[tuple]:
        return iter(())


def table_function(heuristic: type[Heuristic]):
    """The heuristic as a table function: TABLE(lines) in, a row a finding out."""

    class Function:
        @staticmethod
        def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
            missing = set(LINE) - set(lines.dataType.names) if lines.isTable else LINE
            if missing:
                raise ValueError(f"a table of diff lines is needed; it lacks {', '.join(sorted(missing))}")
            of = lines.dataType["diff_id"].dataType
            schema = T.StructType([T.StructField("diff_id", of), *FINDING])
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn("diff_id"), PartitioningColumn("path")], orderBy=[OrderingColumn("pos")])

        def __init__(self):
            self.part, self.file = heuristic(), None

        def _found(self, rows):
            for line, severity, label in rows:
                yield (*self.file, line, self.part.category, severity, label)

        def eval(self, row):
            self.file = (row["diff_id"], row["path"])
            yield from self._found(self.part.line(row))

        def terminate(self):
            if self.file is not None:
                yield from self._found(self.part.end())

    return F.udtf(Function)


def register_heuristic(spark: SparkSession, name: str, heuristic: type[Heuristic]) -> None:
    """SELECT * FROM name(TABLE(lines)) from now on."""
    spark.udtf.register(name, table_function(heuristic))


def findings(lines: DataFrame, *names: str) -> DataFrame:
    """Findings of registered heuristics over lines of diffs, as `review.findings` has them."""
    spark, view = lines.sparkSession, f"lines_{id(lines)}"
    lines.select(*LINE).createOrReplaceTempView(view)
    out = None
    for name in names:
        rows = spark.sql(f"SELECT diff_id, category, path, line, severity, label FROM {name}(TABLE({view}))")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- embedders ----------------------------------------------------------------------------------


class Embedder(ABC):
    """Vectors of texts, a batch at a time."""

    size: int

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def column(self, text: Column) -> Column:
        """The vectors of a text column; null texts as empty ones."""
        part = self

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def run(texts: pd.Series) -> pd.Series:
            found = part.embed(texts.fillna("").tolist())
            if any(len(v) != part.size for v in found) or len(found) != len(texts):
                raise ValueError(f"an embedder of {part.size} components gave something else")
            return pd.Series([list(map(float, v)) for v in found])

        return run(text)


class HashEmbedder(Embedder):
    """The deterministic embedder that needs no model; in the JVM."""

    def __init__(self, size: int = 256):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError("computed as a column")

    def column(self, text: Column) -> Column:
        return similarity.hash_embedding(F.coalesce(text, F.lit("")), self.size)


def register_embedder(spark: SparkSession, name: str, embedder: Embedder) -> None:
    """SELECT name(text) from now on."""
    part = embedder

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in part.embed(texts.fillna("").tolist())])

    spark.udf.register(name, run)


# ---- vector stores ------------------------------------------------------------------------------


class VectorStore(ABC):
    """Records (id, snapshot_id, text, ...) with vectors."""

    @abstractmethod
    def upsert(self, records: DataFrame, order: list[str]) -> None: ...

    @abstractmethod
    def search(self, queries: DataFrame, k: int = 10, snapshot_id: str | None = None) -> DataFrame:
        """(id, other, score, rank) of queries (id, text)."""

    @abstractmethod
    def delete_snapshots(self, snapshots: DataFrame) -> None: ...


class TableVectorStore(VectorStore):
    """A store whose state is a table of the warehouse; each change writes the next version, then takes its name."""

    def __init__(self, spark: SparkSession, name: str, embedder: Embedder, schema: str = "id string, snapshot_id string, text string"):
        self.spark, self.name, self.embedder = spark, name, embedder
        if not spark.catalog.tableExists(name):
            self._write(spark.createDataFrame([], f"{schema}, vector array<double>"))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").saveAsTable(f"{self.name}_next")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(f"ALTER TABLE {self.name}_next RENAME TO {self.name}")

    def upsert(self, records: DataFrame, order: list[str]) -> None:
        last = store.upsert(self.table().drop("vector").limit(0), records, ["id"], order)
        made = last.withColumn("vector", self.embedder.column(F.col("text")))
        self._write(store.upsert(self.table(), made, ["id"], ["id"]))

    def search(self, queries: DataFrame, k: int = 10, snapshot_id: str | None = None) -> DataFrame:
        rows = self.table() if snapshot_id is None else self.table().filter(F.col("snapshot_id") == snapshot_id)
        return similarity.nearest_many(rows.select("id", "vector"), queries.select("id", self.embedder.column(F.col("text")).alias("vector")), k)

    def delete_snapshots(self, snapshots: DataFrame) -> None:
        self._write(store.without(self.table(), snapshots))


# ---- summarisers --------------------------------------------------------------------------------


class Summariser(ABC):
    """Facts to summaries."""

    @abstractmethod
    def modules(self, g: CodeGraph) -> DataFrame:
        """(name, text) of every module."""


class FactSummariser(Summariser):
    """Summaries that say what was counted, without a model."""

    def modules(self, g: CodeGraph) -> DataFrame:
        return module_facts(metrics.module_metrics(g), g).select(F.col("module").alias("name"), F.col("purpose").alias("text"))


class FunctionSummariser(Summariser):
    """A user's function of a batch of facts, a text each."""

    def __init__(self, write: Callable[[list[str]], list[str]]):
        self.write = write

    def modules(self, g: CodeGraph) -> DataFrame:
        write = self.write

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(write(texts.tolist()))

        return FactSummariser().modules(g).withColumn("text", run(F.col("text")))
