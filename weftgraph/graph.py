"""The code graph as DataFrames, keyed by names, and helpers that all operators share."""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Kinds of symbols and edges.
SYMBOL_KINDS = ("namespace", "class", "interface", "struct", "enum", "record", "delegate", "method", "constructor", "property", "field")
EDGE_TYPES = ("imports", "contains", "calls", "inherits", "implements", "uses")
FUNCTIONS, TYPES = ("method", "constructor"), ("class", "struct")

SYMBOLS = T.StructType(
    [
        T.StructField("fq_name", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("parent_fq_name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("signature", T.StringType()),
        T.StructField("modifiers", T.ArrayType(T.StringType())),
        T.StructField("parameters", T.ArrayType(T.StringType())),
        T.StructField("base_types", T.ArrayType(T.StringType())),
        T.StructField("return_type", T.StringType()),
        T.StructField("doc_comment", T.StringType()),
        T.StructField("cyclomatic_complexity", T.IntegerType()),
        T.StructField("cognitive_complexity", T.IntegerType()),
        T.StructField("commit_count", T.IntegerType()),
        T.StructField("author_count", T.IntegerType()),
        T.StructField("last_author", T.StringType()),
        T.StructField("last_modified_at", T.TimestampNTZType()),
        T.StructField("structural_fingerprint", T.StringType()),
        T.StructField("statement_windows", T.ArrayType(T.StringType())),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("edge_type", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("line", T.IntegerType()),
    ]
)
DEPENDENCIES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("ecosystem", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("is_dev", T.BooleanType()),
        T.StructField("is_pinned", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class CodeGraph:
    """Symbols (one row a fq_name), edges between names, and declared dependencies."""

    symbols: DataFrame
    edges: DataFrame
    dependencies: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.symbols.sparkSession

    def of_type(self, *kinds: str) -> DataFrame:
        return self.edges.filter(self.edges.edge_type.isin(*kinds))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share. Where none is set, a local session gets a temporary one; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and re.fullmatch(r"local(\[.*\])?", sc.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into the session's shared checkpoint folder; loops cut their lineage here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(g: CodeGraph) -> CodeGraph:
    """The graph with symbols and edges computed once, for what reads them many times."""
    return CodeGraph(checkpointed(g.symbols), checkpointed(g.edges), g.dependencies)
