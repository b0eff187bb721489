"""Pushes to snapshots: a stream of web hooks whose batches write snapshots, files and symbols together.

A push to the default branch of a known repository makes a snapshot. Its files are compared with those of the
repository's snapshot before the batch: symbols of unchanged files are carried forward, those of
the others are parsed. Several pushes of one repository in a batch are each compared with the last snapshot
before it. A batch is committed at once and exactly once (`BatchTables`), and a snapshot's id comes from its
hook, so a batch that is run again makes the same snapshots.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import checkpointed
from ..operators.snapshots import carry_forward
from ..sources.files import pushes, pushes_to_repos
from .batches import BatchTables

SNAPSHOTS = "snapshot_id string, repo_id string, commit_sha string, at timestamp"
FILES = "snapshot_id string, path string, hash string"


def latest_snapshots(tables: BatchTables, before: int | None = None) -> DataFrame:
    """(repo_id, snapshot_id) of each repository's last snapshot in finished batches."""
    newest = Window.partitionBy("repo_id").orderBy(F.desc("batch"), F.desc("at"), F.desc("snapshot_id"))
    return tables.table("snapshots", SNAPSHOTS, before).withColumn("n", F.row_number().over(newest)).filter("n = 1").select("repo_id", "snapshot_id", "batch")


class Ingest:
    """Writes the batches of a stream of hooks (hook_id, provider, event, payload, at).

    `files_of` gives the files (path, hash, ...) of pushes (snapshot_id, repo_id, commit_sha), with snapshot_id; `parse`
    gives symbols (file_path, ...) of such files, with snapshot_id; `symbols` is their schema.
    """

    def __init__(self, tables: BatchTables, repos: DataFrame, files_of: Callable[[DataFrame], DataFrame], parse: Callable[[DataFrame], DataFrame], symbols: str):
        self.tables, self.repos, self.files_of, self.parse = tables, repos, files_of, parse
        self.symbols = symbols

    def __call__(self, hooks: DataFrame, batch_id: int) -> None:
        t = self.tables
        accepted = pushes_to_repos(pushes(hooks).filter("reason IS NULL"), self.repos)
        snapshots = accepted.select(F.substring(F.sha2(F.concat_ws("\n", F.col("hook_id").cast("string"), "repo_id", "commit_sha"), 256), 1, 12).alias("snapshot_id"), "repo_id", "commit_sha", "at")
        # a hook that is delivered twice makes one snapshot; one that an earlier batch had makes none
        snapshots = checkpointed(snapshots.dropDuplicates(["snapshot_id"]).join(t.table("snapshots", SNAPSHOTS, batch_id).select("snapshot_id"), "snapshot_id", "left_anti"))
        files = checkpointed(self.files_of(snapshots))
        last = latest_snapshots(t, batch_id).select("repo_id", F.col("snapshot_id").alias("old_id"), "batch")
        pairs = checkpointed(snapshots.select("snapshot_id", "repo_id").join(last, "repo_id"))
        # rows of earlier snapshots are found by their batch's folder and id
        earlier = lambda name, schema: t.table(name, schema, batch_id).withColumnRenamed("snapshot_id", "old_id").join(pairs, ["old_id", "batch"]).drop("old_id", "batch", "repo_id")
        old = earlier("files", FILES).select("snapshot_id", "path", F.col("hash").alias("old"))
        compared = files.join(old, ["snapshot_id", "path"], "left")
        changed = compared.filter("old IS NULL OR old <> hash").drop("old")
        # files and symbols of several snapshots at once: a path is a path of its snapshot
        key = lambda c: F.concat_ws("\n", "snapshot_id", c)
        previous = earlier("symbols", self.symbols).withColumn("of_file", F.col("file_path")).withColumn("file_path", F.when(F.col("file_path") != "", key("file_path")).otherwise(""))
        carried = carry_forward(previous, files.select(key("path").alias("path")), changed.select(key("path").alias("path"))).withColumn("file_path", F.col("of_file")).drop("of_file")
        parsed = self.parse(changed)
        t.commit(
            batch_id,
            {"files": files.select("snapshot_id", "path", "hash"), "symbols": parsed.unionByName(carried.select(*parsed.columns)), "snapshots": snapshots},
        )
