"""A user's own parts from SQL; quantiles, pages and masked paths against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph import extensions
from weftgraph.operators import paging, review, usage


class TooManyAdded(extensions.Heuristic):
    """More lines added to a file than taken away."""

    category = "growth"

    def __init__(self):
        self.balance, self.last = 0, 0

    def line(self, row):
        self.balance += {"added": 1, "removed": -1}.get(row["side"], 0)
        self.last = max(self.last, row["number"])
        if "TODO" in row["content"]:
            yield row["number"], "low", "todo"

    def end(self):
        if self.balance > 1:
            yield self.last, "medium", str(self.balance)


class Lengths(extensions.Embedder):
    size = 2

    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_a_heuristic_from_sql(spark):
    diff = "diff --git a/{p} b/{p}\n@@ -1,2 +1,4 @@\n same\n-old\n+new\n+more TODO\n+again\n+last"
    diffs = spark.createDataFrame([(k, "\n".join(diff.format(p=p) for p in ("a.py", "b.py"))) for k in range(3)], "diff_id long, diff string")
    lines = review.diff_lines(diffs)
    extensions.register_heuristic(spark, "too_many_added", TooManyAdded)
    lines.createOrReplaceTempView("the_lines")
    got = [tuple(r) for r in spark.sql("SELECT diff_id, path, line, severity, label FROM too_many_added(TABLE(the_lines)) WHERE category = 'growth' ORDER BY ALL").collect()]
    assert got == [(k, p, *x) for k in range(3) for p in ("a.py", "b.py") for x in ((3, "low", "todo"), (5, "medium", "3"))]
    both = review.findings(lines).select("diff_id", "category", "path", "line", "severity", "label").unionByName(extensions.findings(lines, "too_many_added"))
    assert both.filter("category = 'growth'").count() == len(got)
    with pytest.raises(Exception, match="diff lines"):
        spark.sql("SELECT * FROM too_many_added(TABLE(SELECT 1 AS x))").collect()


def test_an_embedder_and_a_store(spark):
    extensions.register_embedder(spark, "lengths", Lengths())
    assert spark.sql("SELECT lengths(t) AS v FROM VALUES ('abc'), (NULL) AS x(t)").collect() == [([3.0, 1.0],), ([0.0, 1.0],)]
    s = extensions.TableVectorStore(spark, "vectors_test", Lengths())
    rows = lambda *r: spark.createDataFrame(r, "id string, snapshot_id string, text string, at int")
    s.upsert(rows(("a", "s1", "x" * 9, 1), ("b", "s1", "y", 1), ("a", "s1", "xx", 2)).select("id", "snapshot_id", "text"), ["text"])
    s.upsert(rows(("c", "s2", "z" * 5, 1), ("b", "s1", "yyyy", 2)).select("id", "snapshot_id", "text"), ["text"])
    assert {(r.id, len(r.text), r.vector[0]) for r in s.table().collect()} == {("a", 9, 9.0), ("b", 4, 4.0), ("c", 5, 5.0)}
    q = spark.createDataFrame([(1, "12345")], "id int, text string")
    assert [(r.other, r.rank) for r in s.search(q, 1).collect()] == [("c", 1)]
    assert [r.other for r in s.search(q, 5, "s1").orderBy("rank").collect()] == ["b", "a"]
    s.delete_snapshots(spark.createDataFrame([("s1",)], "snapshot_id string"))
    assert [r.id for r in s.table().collect()] == ["c"]
    spark.sql("DROP TABLE vectors_test")


def test_a_summariser(spark, sf_dir):
    from weftgraph.sources import starschema

    g = starschema.graph(spark, sf_dir)
    plain = {r.name: r.text for r in extensions.FactSummariser().modules(g).collect()}
    assert plain and {r.name: r.text for r in extensions.FunctionSummariser(lambda texts: [t.upper() for t in texts]).modules(g).collect()} == {n: t.upper() for n, t in plain.items()}


@pytest.mark.parametrize("bins", [1024, 64])
def test_exact_quantiles(spark, monkeypatch, bins):
    monkeypatch.setattr(usage, "BINS", bins)
    monkeypatch.setattr(usage, "SMALL", 5)
    draw = random.Random(5)
    groups = {"even": [float(k) for k in range(500)], "ties": [1.0] * 300 + [2.0] * 100, "steep": [draw.choice((-1, 1)) * 10 ** draw.uniform(-300, 300) for _ in range(300)], "wide": [-1.7e308, 1.7e308] * 20, "one": [7.0]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("even", None), ("even", float("nan")), ("even", float("inf")), (None, 1.0), ("none", None)]
    draw.shuffle(rows)
    qs = [0.0, 0.5, 0.9, 0.99, 1.0]
    got = {(r.route, r.q): (r.n, r.duration) for r in usage.exact_quantiles(spark.createDataFrame(rows, "route string, duration double"), qs).collect()}
    assert got == {(g, q): (len(v), sorted(v)[min(int(len(v) * q), len(v) - 1)]) for g, v in groups.items() for q in qs}
    assert usage.exact_quantiles(spark.createDataFrame([], "route string, duration double"), qs).count() == 0


def test_latencies_of_all(spark):
    df = spark.createDataFrame([("a", k, k, float((k * 7) % 50)) for k in range(50)], "route string, at long, id long, duration double")
    assert [tuple(r) for r in usage.latencies(df, None).collect()] == [tuple(r) for r in usage.latencies(df, 1000).collect()]


def test_pages(spark):
    df = spark.createDataFrame([(k % 7 if k % 11 else None, k, k) for k in range(300)], "a int, b int, range int").repartition(5)
    want = [tuple(r) for r in df.orderBy("a", "b").collect()]
    index = paging.rank_index(df, ["a", "b"], 8)
    assert index.total == 300 and len(index.ranges) > 4
    for offset in (0, 37, 150, 290, 300, 1000):
        page = index.page(20, offset)
        assert [tuple(r)[:3] for r in page.collect()] == want[offset : offset + 20]
        assert all((r.total, r.has_more) == (300, offset + 20 < 300) for r in page.collect())
    late = index.page(5, 250)
    assert len([p for p, before, n in index.ranges if before < 255 and before + n > 250]) <= 2
    text = spark._jvm.PythonSQLUtils.explainString(late._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [" in text and "range_" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert paging.rank_index(df.limit(0), ["a"], 4).page(5).count() == 0


def test_masked_paths(spark):
    paths = {"/repos/0123456789ab/x": "/repos/{id}/x", "/a/0123456789ag/": "/a/0123456789ag", "//x//": "/x", "": "/", "/DEADBEEF-dead-beef/12345678901": "/{id}/12345678901", None: "/"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.m for r in df.select("p", usage.masked_path(F.col("p")).alias("m")).collect()} == paths
