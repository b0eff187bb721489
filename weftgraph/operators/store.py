"""Keyed tables that change: vectors and notes that are put in or replaced, and rows deleted with their owner.

Each is a plan from the table as it was to the table as it is; writing it under a new name and
switching over keeps a reader, and a task that is run again, on whole data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..helpers import free_name
from . import similarity, snapshots


def upsert(store: DataFrame, records: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """store with records put in: a record replaces the row of its key; of several for one key the last in order counts.

    Rows whose key holds null are never equal to another one and are all kept.
    """
    last = snapshots.latest(records.na.drop(subset=key), key, [F.desc(c) for c in order])
    loose = records.filter(" or ".join(f"`{c}` is null" for c in key))
    return store.join(last.select(*key), key, "left_anti").select(*store.columns).unionByName(last.select(*store.columns)).unionByName(loose.select(*store.columns))


def put_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """notes (snapshot_id, fq_name, note, author, created_at, updated_at) after changes (snapshot_id, fq_name, note, author, at, id).

    The last change's note counts; an author that is empty leaves the one before; the first time stays as creation.
    One aggregation of notes and changes, with a map-side combine.
    """
    key = ["snapshot_id", "fq_name"]
    old = notes.select(*key, "note", "author", F.col("created_at").alias("at"), F.col("updated_at").alias("to"), F.lit(None).cast("long").alias("id"))
    new = changes.select(*key, "note", "author", "at", F.col("at").alias("to"), F.col("id").cast("long").alias("id"))
    rank = F.struct(F.col("id").isNotNull(), "to", "id")  # what was there comes before every change
    named = F.coalesce("author", F.lit("")) != ""
    return old.unionByName(new).groupBy(*key).agg(
        F.max_by("note", rank).alias("note"), F.coalesce(F.max_by("author", F.when(named, rank)), F.lit("")).alias("author"), F.min("at").alias("created_at"), F.max("to").alias("updated_at")
    )


def without(table: DataFrame, deleted: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """table without the rows of the deleted keys; rows of no key stay."""
    return table.join(deleted.select(key).distinct(), key, "left_anti").select(*table.columns)


def cascade(tables: dict[str, DataFrame], snapshots_of: DataFrame, deleted_repos: DataFrame) -> dict[str, DataFrame]:
    """tables (snapshot_id, ...) after repositories and with them their snapshots (snapshot_id, repo_id) are deleted."""
    gone = snapshots_of.join(deleted_repos.select("repo_id").distinct(), "repo_id", "left_semi")
    return {name: without(df, gone) for name, df in tables.items()}


def embedded(records: DataFrame, dimensions: int = 256) -> DataFrame:
    """records (id, text, ...) with `vector`: the hash embedding of each text, in the JVM's own batches."""
    return records.withColumn("vector", similarity.hash_embedding(F.col("text"), dimensions))


def put_vectors(store: DataFrame, records: DataFrame, order: list[str], dimensions: int = 256) -> DataFrame:
    """store (id, ..., vector) after records (id, text, ...) are embedded and put in. Only the last record of an id is embedded."""
    at = free_name(records, "at")
    last = snapshots.latest(records.withColumn(at, F.struct(*order)), ["id"], [F.desc(at)]).drop(at)
    return upsert(store, embedded(last, dimensions), ["id"], ["id"])
