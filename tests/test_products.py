"""Joins by blocks and by trigrams against plain loops; answers' evidence and verification."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import facts, similarity, substring


@pytest.mark.parametrize("cell", [4096, 7])
def test_nearest_many(spark, monkeypatch, cell):
    monkeypatch.setattr(similarity, "CELL", cell)
    draw = np.random.default_rng(1)
    rows = [(i, draw.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)] + [(100, None), (101, [1.0, None, 0.0, 0.0]), (None, [1.0] * 4), (102, [0.0] * 4), (103, [1.0, 2.0]), (104, []), (105, [2.0, 4.0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("unit", F.lit("x")).repartition(3)
    queries = vectors.filter("id % 3 = 0 or id > 100")

    def cosine(a, b):
        n = np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))
        return round(float(np.dot(a, b) / n), 6) + 0.0 if n else 0.0

    whole = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    want = set()
    for i, v in whole:
        if i % 3 == 0 or i > 100:
            near = sorted((-cosine(v, w), j) for j, w in whole if len(w) == len(v))[:5]
            want |= {(i, j, -s + 0.0, k) for k, (s, j) in enumerate(near, 1)}
    assert {tuple(r) for r in similarity.nearest_many(vectors, queries, 5).select("id", "other", "score", "rank").collect()} == want
    assert similarity.nearest_many(vectors.limit(0), queries, 5).count() == similarity.nearest_many(vectors, queries.limit(0), 5).count() == 0


def test_copies_of_the_product_grow_with_its_rows_only(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELL", 4)
    monkeypatch.setattr(similarity, "_product", lambda k: lambda v, q: pa.table([q.column("id").slice(0, 1), v.column("other").slice(0, 1), pa.array([float(v.num_rows + q.num_rows)])], names=["id", "other", "score"]) if v.num_rows and q.num_rows else pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}))
    moved = {}
    for n in (100, 400):
        rows = spark.range(n).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
        moved[n] = similarity.nearest_many(rows, rows, 10**6).agg(F.sum("score")).first()[0]
    assert moved[400] <= 4.5 * moved[100] and moved[400] <= 16 * 400


def test_best_of_parts_equals_the_whole_product(monkeypatch):
    monkeypatch.setattr(similarity, "CELL", 7)
    monkeypatch.setattr(similarity, "STEP", 3)
    draw = np.random.default_rng(2)
    for x, q in ((draw.normal(size=(40, 3)), draw.normal(size=(8, 3))), (draw.integers(-1, 2, (40, 2)).astype(float), np.ones((8, 2))), (np.ones((40, 2)), np.ones((2, 2))), (np.ones((3, 2)), np.ones((2, 2)))):
        names = draw.permutation(len(x))
        table = lambda name, ids, m: pa.table({name: pa.array(ids), "unit": pa.array([r.tobytes() for r in m], pa.binary()), "width": pa.array([m.shape[1]] * len(m), pa.int32())})
        got = [tuple(r.values()) for r in similarity._product(5)(table("other", names, x), table("id", range(len(q)), q)).to_pylist()]
        scores = np.round(q @ x.T, 6) + 0.0
        assert sorted(got) == sorted((i, int(names[j]), scores[i, j]) for i in range(len(q)) for j in np.lexsort((names, -scores[i]))[:5])


def test_holders(spark):
    names = ["app.User", "app.UserService", "a", "ab", "xabx", "user", "", None, "aaaaab", "app.Üser"]
    refs = ["User", "a", "ab", "", None, "app", "aab", "zzz", "app.UserService", "Üs", "s", "aaaa", "serv"]
    index = substring.name_index(spark.createDataFrame([(n,) for n in names + names], "name string"))
    got = [tuple(r) for r in substring.holders(spark.createDataFrame([(r,) for r in refs + refs], "ref string"), index).collect()]
    assert sorted(got) == sorted((r, n) for r in refs if r for n in names if n and r in n)


def test_answers_name_their_evidence(spark):
    q = spark.createDataFrame([(1, "impact"), (2, "general"), (3, "architecture")], "id int, question_type string")
    symbols = spark.createDataFrame([(1, "a.b", "b", "class", "a.py", 3, 9, None)] + [(1, f"a.c{k}", "c", "method", "c.py", k, k, "s") for k in range(4)], "id int, fq_name string, name string, kind string, file_path string, start_line int, end_line int, signature string")
    edges = spark.createDataFrame([(1, 1, "x", "a.b", "", 4), (1, 1, "y", "a.b", "y.py", None)], "id int, hop int, source string, target string, file_path string, line int")
    texts = spark.createDataFrame([("f", "file", "File: f", [("f.py", None, None, None), ("", "", 1, 1), ("g.py", "g", 1, 2)])], f"key string, scope_type string, text string, refs array<{facts.REF}>")
    modules = spark.createDataFrame([(f"m{k}", f"module {k}", None) for k in range(9)], f"name string, text string, refs array<{facts.REF}>")
    near = facts.related_summaries(q.filter("id <> 2").withColumn("text", F.lit("how?")), texts, modules)
    got = {r.id: r for r in facts.answers(q, symbols, edges, near).collect()}
    assert [(e.file_path, e.symbol, e.start_line, e.relevance) for e in got[1].evidence][-2:] == [("y.py", "", 0, "Call from y to a.b"), ("f.py", "", 0, "Vector search match")]
    assert [v.description for v in got[1].verification] == [facts.VERIFICATION["impact"][0][0], facts.VERIFICATION["impact"][1][0], "Review `a.b` in `a.py`", "Review `a.c0` in `c.py`", "Review `a.c1` in `c.py`"]
    assert (got[1].confidence, got[2].confidence, got[2].answer_text, got[2].evidence) == ("high", "low", facts.SENTENCES["nothing"], [])
    assert "**Related summaries** (10 found):\n  - [file] File: f\n  - [module_summary] module 0" in got[3].answer_text and got[3].answer_text.count("module_summary") == 4
