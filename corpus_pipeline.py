"""A corpus pipeline of five operators: what each stage decides takes effect on the next one's documents.

Every stage works on all documents that its predecessor kept. `run` writes each result as
Parquet to the folder that all executors share, and reads it again, which also cuts lineage.

Defined cases: null and empty texts fail the quality rules and go; of documents that link, the one with the
smallest id stays (none counts as the smallest), and of its repeated rows one; of strings that repeat, the one that starts in the smallest id, and there first, stays; texts of any length pass whole;
extra columns of any name and type are kept by all stages but the last; an empty table gives empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import ngram_join, packing, quality_rules, queries, secret_scan, suffix_dedup
from weftgraph.llm.blocks import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs, "v2")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs, n=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.documents(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]

#: SQL has no suffix arrays, tokenizers or best fit; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
