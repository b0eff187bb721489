"""Graph walks by rounds and in one task, checks that read texts, and the review's patterns."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.operators import evaluate, review, traverse


def links_of(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string")


@pytest.mark.parametrize("steps", [1, 12])
def test_reachable(spark, monkeypatch, steps):
    monkeypatch.setattr(traverse, "STEPS", steps)
    links = links_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("y", "y"), (None, "z"), ("d", None)])
    seeds = spark.createDataFrame([("b",), ("b",), ("lone",), (None,)], "node string")
    assert sorted(r.node for r in traverse.reachable(links, seeds).collect()) == ["a", "b", "c", "d", "lone"]


def test_reachable_of_random_graphs(spark, monkeypatch):
    monkeypatch.setattr(traverse, "STEPS", 1)
    rng = random.Random(7)
    pairs = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(75)]
    seen, todo = {"n03", "n11"}, ["n03", "n11"]
    while todo:
        x = todo.pop()
        new = {b for a, b in pairs if a == x} - seen
        seen |= new
        todo += new
    got = [r.node for r in traverse.reachable(links_of(spark, pairs), spark.createDataFrame([("n03",), ("n11",)], "node string")).collect()]
    assert sorted(got) == sorted(seen)


def test_long_chains(spark):
    n = 20_000
    name = lambda c: F.format_string("c%06d", c)
    chain = spark.range(n).select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b"))
    assert traverse.reachable(chain, spark.createDataFrame([("c000000",)], "node string")).count() == n + 1
    edges = chain.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("inherits").alias("edge_type"), F.lit("f").alias("file_path"), F.lit(0).alias("line"))
    depth = traverse.inheritance_depth(CodeGraph(spark.createDataFrame([], "fq_name string"), edges))
    assert depth.filter(F.col("depth") != n - F.substring("fq_name", 2, 6).cast("int")).count() == 0 and depth.count() == n
    ring = chain.unionByName(spark.createDataFrame([(f"c{n:06d}", "c010000"), ("x", "y"), ("y", "x")], "a string, b string"))
    assert {(r.component, r.size) for r in traverse.cycles(ring).collect()} == {("c010000", n - 10_000 + 1), ("x", 2)}


def components_of(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    to = {x: reach(x) for x in {y for p in pairs for y in p}}
    out = {tuple(sorted({y for y in to[x] if x in to[y]} | {x})) for x in to}
    return {c for c in out if len(c) > 1}


def test_cycles(spark):
    rng = random.Random(2)
    pairs = [("m01", "m01")]
    # parts of their own: sparse and dense ones, ears, a figure eight, a ring with tails
    for part, (size, links) in enumerate([(24, 26), (12, 40), (30, 33), (20, 21)]):
        pairs += [(f"p{part}{rng.randrange(size):02d}", f"p{part}{rng.randrange(size):02d}") for _ in range(links)]
    pairs += [("e1", "e2"), ("e2", "e1"), ("e2", "e3"), ("e3", "e4"), ("e4", "e2"), ("t", "e1"), ("e4", "u"), ("u", "v")]
    pairs += [("f0", "f1"), ("f1", "f0"), ("f0", "f2"), ("f2", "f3"), ("f3", "f0"), ("g0", "g1"), ("g1", "g2"), ("g2", "g0")]
    got = {tuple(r.members.split(",")) for r in traverse.cycles(links_of(spark, pairs)).collect()}
    assert got == components_of([p for p in pairs if p[0] != p[1]])


def test_inheritance_depth(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("into", "x"), ("self", "self"), ("two", "a"), ("two", "x")]
    edges = spark.createDataFrame([(s, t, "inherits", "f", 0) for s, t in rows], "source string, target string, edge_type string, file_path string, line int")
    g = CodeGraph(spark.createDataFrame([], "fq_name string"), edges)
    got = {r.fq_name: r.depth for r in traverse.inheritance_depth(g).collect()}
    assert got == {"a": 3, "b": 2, "c": 1, "x": 2, "y": 2, "into": 3, "self": 1, "two": 3}


def test_removed_guards_whatever_their_case(spark):
    removed = ["guard.Against(x);", "argumentexception e", "GUARD.Not(y);", "plain"]
    text = "diff --git a/f b/f\n@@ -1,4 +1,0 @@\n" + "\n".join("-" + r for r in removed)
    lines = review.diff_lines(spark.createDataFrame([(1, text)], "diff_id int, diff string"))
    got = {(r.line, r.label) for r in review.findings(lines).filter("category = 'removed_validation'").collect()}
    assert got == {(1, "guard"), (2, "exception"), (3, "guard")}


def test_contained(spark):
    names = spark.createDataFrame([("alpha.beta",), ("gamma",), ("ab",), ("",), (None,)], "name string")
    refs = spark.createDataFrame([("gamma",), ("pha.b",), ("x",), ("a",), ("et",), ("zz",), ("alphabeta",), ("",), (None,)], "ref string")
    assert sorted(r.ref for r in evaluate.contained(refs, names).collect()) == ["a", "et", "gamma", "pha.b"]


def test_checks_of_nothing(spark):
    answers = spark.createDataFrame([(1, None, [], []), (2, "`nope`", ["f"], ["x.nope"])], "scope int, text string, citations array<string>, expected array<string>")
    files = spark.createDataFrame([("f",)], "path string")
    symbols = spark.createDataFrame([("a.b",)], "fq_name string")
    row = lambda df: {r.scope: (r.score, r.passed, r.severity) for r in df.collect()}
    assert row(evaluate.citation_coverage(answers, files)) == {1: (0.5, True, "warning"), 2: (1.0, True, "pass")}
    assert row(evaluate.factual_grounding(answers, symbols, files)) == {1: (0.7, True, "pass"), 2: (0.0, False, "warning")}
    assert row(evaluate.answer_completeness(answers)) == {1: (1.0, True, "pass"), 2: (1.0, True, "pass")}
    stale = evaluate.doc_staleness(answers.select("scope", F.lit("s1").alias("snapshot")), spark.createDataFrame([("s2",)], "snapshot string"))
    assert row(stale) == {1: (0.0, False, "warning"), 2: (0.0, False, "warning")}
