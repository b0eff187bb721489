"""Streams against batch results: replays, bounded state, late rows."""

import json
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_text_and_sources import bucket
from weftgraph.operators import usage
from weftgraph.streaming import ingest, state, windows
from weftgraph.streaming import usage as streaming
from weftgraph.streaming.batches import BatchTables

T0 = datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """A frame with `part` as a stream of one file a part."""

    def make(df):
        parts = sorted(r.part for r in df.select("part").distinct().collect())
        (tmp_path / "in").mkdir()
        for k in parts:
            df.filter(F.col("part") == k).drop("part").coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
            for f in (tmp_path / f"part{k}").glob("*.parquet"):
                f.rename(tmp_path / "in" / f"{k:03d}.parquet")
        return streaming.events_stream(spark, str(tmp_path / "in"), df.drop("part").schema)

    return make


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(150)
    return q


@pytest.fixture
def rocksdb(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_limiter_forgets_full_buckets(spark, stream, rocksdb):
    # key 0 stops after the first part, key 1 goes on for hours
    rows = [(0, k, k * 0.3, 0) for k in range(20)] + [(1, 100 + k, k * 0.3 + 5000 * p, p) for p in range(4) for k in range(20)]
    df = spark.createDataFrame([(key, i, T0 + timedelta(seconds=s), p) for key, i, s, p in rows], "key long, id long, at timestamp, part int")
    q = run(state.rate_limited(stream(df), 0.5, 4, "10 seconds"), "limited", "append")
    got = {r.id: r.allowed for r in spark.table("limited").collect()}
    assert got == bucket([r[:3] for r in rows], 0.5, 4)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) > kept[-1]  # key 0 and its timer are gone


def test_last_durations_are_the_batch_s(spark, stream, rocksdb):
    rows = [(f"r{k % 3}", T0 + timedelta(seconds=k), k, float((k * 37) % 101), k // 40) for k in range(120)]
    df = spark.createDataFrame(rows, "route string, at timestamp, id long, duration double, part int")
    run(state.last_durations(stream(df), 25), "durations", "update")
    last = {}
    for r in spark.table("durations").collect():
        last[r.route] = tuple(r)
    assert set(last.values()) == {tuple(r) for r in usage.latencies(df, 25).select("route", "n", "total", "p50", "p99").collect()}


def test_sessions_and_counts_are_the_batch_s(spark, stream):
    rows = [(k % 3, "a", 1, T0 + timedelta(minutes=7 * k + (200 if k > 20 else 0)), f"/x/{k % 2}", str(200 + k % 2), k // 14) for k in range(42)]
    df = spark.createDataFrame(rows, "user_id long, action string, tokens long, at timestamp, route string, status string, part int")
    s = stream(df)
    for name, make in (("sessions", lambda d: streaming.sessions(d, "30 minutes", "1 day")), ("counts", lambda d: streaming.request_counts(d, "1 day")), ("hops", lambda d: windows.hopping(d, ["route"], "1 hour", "20 minutes", "1 day"))):
        run(make(s), name, "complete")
        assert Counter(map(tuple, spark.table(name).collect())) == Counter(map(tuple, make(df).collect())), name
        assert spark.table(name).count() > 3


def test_late_rows_and_windows_are_the_batch_s(spark, stream, tmp_path):
    # part 2 holds rows hours behind the rows of parts 0 and 1
    rows = [(T0 + timedelta(minutes=13 * k - (600 if k % 5 == 0 and k >= 60 else 0)), f"r{k % 2}", k // 30) for k in range(90)] + [(None, "r0", 1)]
    df = spark.createDataFrame(rows, "at timestamp, route string, part int")
    sink = windows.HoppingWindows(BatchTables(spark, str(tmp_path / "out")), ["route"], "2 hours", "30 minutes", "1 hour")
    sink.tables.run(stream(df), str(tmp_path / "check"), sink).awaitTermination(150)
    sink(df.filter("part = 2").drop("part"), 2)  # replayed: nothing changes
    sums = Counter()
    for name in ("windows", "late"):
        for r in sink.result(name).collect():
            sums[r.start, r.end, r.route] += r.n
    assert sums == Counter({(r.start, r.end, r.route): r.n for r in sink.counted(df.filter("at IS NOT NULL")).collect()})
    assert sink.result("late").count() > 0


# ---- pushes ----------------------------------------------------------------------------------

SYMBOLS = "snapshot_id string, file_path string, fq_name string, parsed_in string"
#: commit -> its files with their contents
TREES = {"c1": {"a.py": "A", "b.py": "B"}, "c2": {"a.py": "A", "b.py": "B2", "c.py": "C"}, "c3": {"c.py": "C", "b.py": "B2"}, "d1": {"a.py": "Z"}}


def hook(i, url, sha, ref="refs/heads/main", event="push"):
    return (i, "github", event, json.dumps({"repository": {"clone_url": url}, "ref": ref, "after": sha}), datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=i))


def test_pushes_are_ingested_once(spark, stream, tmp_path):
    trees = spark.createDataFrame([(c, p, t) for c, files in TREES.items() for p, t in files.items()], "commit_sha string, path string, hash string")
    repos = spark.createDataFrame([("one", "https://x/One.git", "main"), ("two", "https://x/two/", "main")], "repo_id string, url string, default_branch string")
    hooks = [(*hook(1, "https://x/one", "c1"), 0), (*hook(2, "https://x/two.git", "d1"), 0), (*hook(2, "https://x/two.git", "d1"), 0), (*hook(3, "https://x/one", "c2", ref="refs/heads/dev"), 0), (*hook(4, "https://x/one", "c2"), 1), (*hook(1, "https://x/one", "c1"), 1), (*hook(5, "https://x/ONE", "c3"), 2), (*hook(6, "https://x/none", "c3"), 2)]
    df = spark.createDataFrame(hooks, "hook_id long, provider string, event string, payload string, at timestamp, part int")

    def parse(files):
        return files.select("snapshot_id", F.col("path").alias("file_path"), F.concat("path", F.lit("."), "hash").alias("fq_name"), F.col("snapshot_id").alias("parsed_in"))

    class Falls(BatchTables):
        """Loses the executor that writes the mark of batch 1, once."""

        falls = 1

        def commit(self, batch_id, frames, mark=None):
            if batch_id == 1 and self.falls:
                self.falls -= 1
                [f.write.mode("overwrite").parquet(f"{self.folder}/{n}/batch={batch_id}") for n, f in frames.items()]
                raise RuntimeError("lost")
            super().commit(batch_id, frames, mark)

    tables = Falls(spark, str(tmp_path / "out"))
    each = ingest.Ingest(tables, repos, lambda p: p.join(trees, "commit_sha").select("snapshot_id", "path", "hash"), parse, SYMBOLS)
    s = stream(df)
    with pytest.raises(Exception, match="lost"):
        tables.run(s, str(tmp_path / "check"), each).awaitTermination(150)
    # written, but without its mark: not there
    assert {r.commit_sha for r in tables.table("snapshots", ingest.SNAPSHOTS).collect()} == {"c1", "d1"}
    tables.run(s, str(tmp_path / "check"), each).awaitTermination(150)
    each(df.filter("part = 2").drop("part"), 2)  # replayed
    snapshots = {r.snapshot_id: r for r in tables.table("snapshots", ingest.SNAPSHOTS).collect()}
    assert sorted(r.commit_sha for r in snapshots.values()) == ["c1", "c2", "c3", "d1"]
    got = Counter((snapshots[r.snapshot_id].commit_sha, r.file_path, r.fq_name, snapshots[r.parsed_in].commit_sha) for r in tables.table("symbols", SYMBOLS).collect())
    assert got == Counter([("c1", "a.py", "a.py.A", "c1"), ("c1", "b.py", "b.py.B", "c1"), ("d1", "a.py", "a.py.Z", "d1"), ("c2", "a.py", "a.py.A", "c1"), ("c2", "b.py", "b.py.B2", "c2"), ("c2", "c.py", "c.py.C", "c2"), ("c3", "b.py", "b.py.B2", "c2"), ("c3", "c.py", "c.py.C", "c2")])
    assert {(r.repo_id, snapshots[r.snapshot_id].commit_sha) for r in ingest.latest_snapshots(tables).collect()} == {("one", "c3"), ("two", "d1")}
