"""Findings that are counted where they fire."""

from pyspark.sql import functions as F

from weftgraph import sinks
from weftgraph.graph import CodeGraph
from weftgraph.operators import rules

SYMBOLS = "fq_name string, name string, kind string, file_path string, namespace string, parent_fq_name string, start_line int, end_line int, signature string, modifiers array<string>, parameters array<string>, return_type string, doc_comment string"


def test_counts_equal_findings_and_unread_columns_are_not_computed(spark):
    rows = [(f"a.f{k}", f"f{k}", kind, "a.py", "a", None, 1, 1 + 20 * k, "", [], ["p"] * k, "", "") for k in range(8) for kind in (("class", "method")[k % 2],)]
    symbols = spark.createDataFrame(rows, SYMBOLS)
    edges = spark.createDataFrame([("a.f1", "a.f3", "calls", "a.py", 1), ("a.f0", "a.f1", "contains", "a.py", 1)], "source string, target string, edge_type string, file_path string, line int")
    found = rules.findings(CodeGraph(symbols, edges), categories=["clean_code", "documentation"])
    counts = {(r.category, r.severity): r["count"] for r in found.groupBy("category", "severity").count().collect()}
    assert len(counts) > 1
    fails = F.raise_error(F.lit("computed")).cast("int")
    unread = CodeGraph(symbols.withColumn("author_count", fails), edges)
    counted = rules.findings(unread, categories=["clean_code", "documentation"], per=("category", "severity"))
    assert {(r.category, r.severity): r.n for r in counted.collect()} == counts
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(rules.counted_scores(counted, symbols)) == key(rules.scores(found, symbols))
    assert key(sinks.severity_table(counted.groupBy("severity").agg(F.sum("n").alias("n")))) == key(sinks.markdown_summary(found))
