"""Accounts, stored tables, exports, hooks and generated documents on small cases."""

import gzip
import json

import pytest

from weftgraph import sinks
from weftgraph.graph import EDGES, SYMBOLS, CodeGraph
from weftgraph.operators import accounts, documents, snapshots, store
from weftgraph.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_access_of_unknown_users_and_repositories(spark):
    users = spark.createDataFrame([(1, "user"), (2, "admin"), (3, None)], "user_id long, role string")
    repos = spark.createDataFrame([(10, 1), (11, None)], "repo_id long, owner_id long")
    asked = spark.createDataFrame([(1, 10), (1, 11), (2, 99), (3, 10), (4, 10), (None, None)], "user_id long, repo_id long")
    assert rows(accounts.access(asked, users, repos)) == sorted([(1, 10, True), (1, 11, False), (2, 99, True), (3, 10, False), (4, 10, False), (None, None, False)], key=repr)


def test_every_refused_field_is_named(spark):
    kind = "name string, url string, default_branch string, git_provider string, git_token string"
    r = spark.createDataFrame([(" ", "ftp://localhost", "..", "svn", "t" * 1025), (None, None, None, None, None), (" a ", "https://me@Host:1/x", None, " GitHub ", "")], kind)
    got = [(x.name, x.git_provider, x.reasons) for x in accounts.validated(r).collect()]
    assert got == [("", "svn", ["name", "url", "default_branch", "git_provider", "git_token"]), ("", "github", ["name", "url"]), ("a", "github", [])]


def test_plans_with_broken_or_absent_limits_are_unlimited(spark):
    s = spark.sql("select * from values (1L, 7L, 'x', timestamp_ntz'2024-01-01', true), (2L, 7L, 'y', timestamp_ntz'2024-02-01', false), (3L, 8L, 'y', timestamp_ntz'2024-02-01', true), (4L, 9L, 'z', timestamp_ntz'2024-02-01', true) t(id, user_id, plan_id, started_at, is_active)")
    p = spark.createDataFrame([("x", '{"type": "time_based", "trial_days": 10}'), ("y", None), ("z", "{no")], "plan_id string, limits string")
    at = accounts.trials(accounts.active_plans(s, p), "2024-01-09 12:00:00")
    assert rows(at.select("user_id", "limit_type", "expired", "days_left")) == [(7, "time_based", False, 1), (8, "unlimited", False, None), (9, "unlimited", False, None)]
    assert accounts.trials(accounts.active_plans(s, p), "2024-01-11 00:00:00").filter("expired").count() == 1


def test_upsert_keeps_rows_of_no_key_and_extra_columns(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, row string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (None, "m", 1)], "id long, row string, at int")
    assert rows(store.upsert(old, new, ["id"], ["at"])) == sorted([(1, "a"), (2, "d"), (3, "e"), (None, "n"), (None, "m")], key=repr)
    assert rows(store.upsert(old.limit(0), new.limit(0), ["id"], ["at"])) == []


def test_latest_leaves_a_column_named_row_alone(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id long, row string, _row int")
    assert rows(snapshots.latest(df, ["id"], [df["_row"].desc()])) == [(1, "b", 2)]


def test_notes_keep_the_author_before_an_empty_one(spark):
    kind = "snapshot_id string, fq_name string, note string, author string, created_at int, updated_at int"
    old = spark.createDataFrame([("s", "f", "old", "ann", 1, 1), ("s", "g", "kept", "", 1, 1)], kind)
    new = spark.createDataFrame([("s", "f", "new", "", 5, 1), ("s", "h", "first", None, 6, 2)], "snapshot_id string, fq_name string, note string, author string, at int, id long")
    assert rows(store.put_notes(old, new)) == [("s", "f", "new", "ann", 1, 5), ("s", "g", "kept", "", 1, 1), ("s", "h", "first", "", 6, 6)]


def test_deleting_a_repository_deletes_its_snapshots(spark):
    of = spark.createDataFrame([("s1", "r1"), ("s2", "r2")], "snapshot_id string, repo_id string")
    t = spark.createDataFrame([("s1", 1), ("s2", 2), (None, 3)], "snapshot_id string, v int")
    left = store.cascade({"t": t}, of, of.filter("repo_id = 'r1'"))["t"]
    assert rows(left) == sorted([("s2", 2), (None, 3)], key=repr)


def test_portable_payloads_are_refused_for_a_reason(spark, monkeypatch):
    pack = lambda x: gzip.compress(json.dumps(x).encode())
    given = [b"", b"text", gzip.compress(b"{"), gzip.compress(b"[1]"), pack({"schema_version": 2, "metadata": {}}), pack({"schema_version": 1}), pack({"metadata": {}}), pack({"metadata": {}})[:-9]]
    df = spark.createDataFrame([(str(k), len(c), bytearray(c)) for k, c in enumerate(given)] + [("8", 300 << 20, None)], "path string, length long, content binary")
    got = {r.path: r.reason for r in sinks.portable_reasons(df).collect()}
    assert [got[str(k)] for k in range(9)] == ["empty", "not gzip", "not JSON", "not JSON", "newer schema version", "no metadata", None, "not gzip", "too large"]


def test_hooks_that_are_no_push(spark):
    df = spark.createDataFrame([("github", "ping", "{}"), ("other", None, "no json"), ("other", None, None), ("gitlab", "Push Hook", '{"project": {"http_url": "u"}, "ref": "main"}')], "provider string, event string, payload string")
    assert rows(files.pushes(df).select("provider", "url", "ref", "reason")) == sorted([("github", None, None, "another event"), ("other", None, None, "no url"), ("other", None, None, "no url"), ("gitlab", "u", "main", None)], key=repr)
    assert files.token_matches("s", "s") and not files.token_matches("s", None)


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def run():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("not yet")
        return "done"

    assert files.retried(run, wait=waits.append) == "done" and waits == [2.0, 4.0, 8.0]
    with pytest.raises(OSError):
        files.retried(lambda: (_ for _ in ()).throw(OSError()), most=1, wait=waits.append)


def _graph(spark):
    row = lambda **k: tuple(k.get(f.name) for f in SYMBOLS)
    s = [
        row(fq_name="m.A", name="A", kind="class", file_path="m/a.py", namespace="m", start_line=1, end_line=9, signature="class A", modifiers=["public"]),
        row(fq_name="m.A.f", name="f", kind="method", file_path="m/a.py", namespace="m", start_line=2, end_line=2, modifiers=["public"]),
        row(fq_name="m.A.g", name="app_config", kind="method", file_path="m/a.py", namespace="m", start_line=3, end_line=4, modifiers=None),
        row(fq_name="x", name="x", kind=None, file_path=None, namespace=None, start_line=0, end_line=0),
    ]
    e = [("m.A.g", "m.A.f", "calls", "m/a.py", 3), ("m", "json", "imports", "m/a.py", None)]
    return CodeGraph(spark.createDataFrame(s, SYMBOLS), spark.createDataFrame(e, EDGES))


def test_module_documents_and_their_markdown(spark, tmp_path):
    g = _graph(spark)
    lines = documents.module_documents(g)
    of = lambda h: [r.line for r in lines.filter(lines.heading == h).filter("scope = 'm'").orderBy("key").collect()]
    assert of("Overview") == ["Module `m` contains 3 symbols across 1 files."]
    assert of("Classes & Interfaces") == ["- **`m.A`** (class): `class A`"] and of("Public API") == ["- `f`"] and of("Internal Details") == ["1 internal members."]
    documents.markdown(lines.filter("scope = 'm'"), str(tmp_path / "md"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "md" / "doc_type=module").glob("*.txt")))
    assert text.startswith("## Overview\nModule `m`") and text.index("## Files") < text.index("## Public API")
    assert rows(documents.external_dependencies(g)) == [("json",)]
    shown = {r.heading for r in documents.readme(g, g.symbols.filter("kind = 'class'").select("fq_name", "kind")).collect()}
    assert {"Overview", "Tech Stack", "Entry Points", "Configuration", "Dependencies"} <= shown


def test_documents_and_exports_of_an_empty_graph(spark):
    g = _graph(spark)
    empty = CodeGraph(g.symbols.limit(0), g.edges.limit(0))
    assert documents.module_documents(empty).count() == 0 and documents.kind_counts(empty).count() == 0
    assert [r.section for r in documents.readme(empty, empty.symbols.select("fq_name", "kind")).collect()] == [0]
    out = sinks.json_export(empty).collect()
    assert [(r.section, json.loads(r.json)["symbol_count"]) for r in out] == [("metadata", 0)]


def test_json_export_of_summaries_that_are_no_json(spark, tmp_path):
    said = spark.createDataFrame([("symbol", "m.A", '{"purpose": "p"}'), ("symbol", "x", "no json"), ("file", None, None)], "scope_type string, scope_id string, summary_json string")
    out = sinks.json_export(_graph(spark), said)
    got = [json.loads(r.json).get("summary") for r in out.filter("section = 'summaries'").orderBy("place").collect()]
    assert sorted(got, key=repr) == sorted([{"purpose": "p"}, {}, {}], key=repr)
    sinks.write_json(out, str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).count() == out.count()
