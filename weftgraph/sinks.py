"""Outputs: JSON, CSV in a ZIP, SARIF, Markdown, Mermaid, Prometheus text, and portable snapshots.

Rows are shaped by DataFrames; a report that is one document is read by its rows in order,
which are bounded by what a report shows.
"""

from __future__ import annotations

import gzip
import io
import json
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import DEPENDENCIES, EDGES, SYMBOLS, CodeGraph

#: Levels of SARIF by severity, and the columns of the CSV files.
SARIF_LEVELS = {"critical": "error", "error": "error", "warning": "warning", "info": "note", "hint": "note"}
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SEVERITIES = ("critical", "error", "warning", "info")


def sarif_results(findings: DataFrame) -> DataFrame:
    level = F.lit("warning")
    for s, v in SARIF_LEVELS.items():
        level = F.when(F.col("severity") == s, v).otherwise(level)
    text = F.concat("rule_name", F.lit(": "), "symbol_fq_name")
    return findings.select(F.col("rule_id"), level.alias("level"), text.alias("text"), F.col("file_path").alias("uri"), F.greatest(F.col("line"), F.lit(1)).alias("start_line"))


def sarif(findings: DataFrame, tool: str = "weftgraph", version: str = "1.0.0") -> str:
    """A SARIF 2.1.0 document of all findings."""
    rules = [{"id": r.rule_id, "name": r.rule_name} for r in findings.select("rule_id", "rule_name").distinct().orderBy("rule_id").collect()]
    results = []
    for r in sarif_results(findings).orderBy("rule_id", "uri", "start_line", "text").toLocalIterator():
        place = {"physicalLocation": {"artifactLocation": {"uri": r.uri}, "region": {"startLine": r.start_line}}}
        results.append({"ruleId": r.rule_id, "level": r.level, "message": {"text": r.text}} | ({"locations": [place]} if r.uri else {}))
    return json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "version": version, "rules": rules}}, "results": results}]})


def safe_id(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[.\- ]", "_"), "[<>]", "")


def mermaid_modules(g: CodeGraph, deps: DataFrame, most: int = 80) -> DataFrame:
    """(position, line) of a flow chart of namespaces (the first `most` by name) and their dependencies."""
    n = g.symbols.filter("namespace <> ''").groupBy("namespace").agg(F.count("*").alias("n")).orderBy("namespace").limit(most)
    nodes = n.select(F.lit(1).alias("part"), F.concat(F.lit("    "), safe_id(F.col("namespace")), F.lit('["'), "namespace", F.lit("<br/>"), F.col("n").cast("string"), F.lit(' symbols"]')).alias("line"))
    shown = n.select("namespace")
    links = deps.join(shown.withColumnRenamed("namespace", "a"), "a", "left_semi").join(shown.withColumnRenamed("namespace", "b"), "b", "left_semi")
    arrows = links.select(F.lit(2).alias("part"), F.concat(F.lit("    "), safe_id(F.col("a")), F.lit(" --> "), safe_id(F.col("b"))).alias("line"))
    return nodes.unionByName(arrows)


def mermaid_classes(g: CodeGraph, members: DataFrame, most: int = 80) -> DataFrame:
    """(part, line) of a class diagram: classes, their first members, and inheritance among those shown."""
    c = g.symbols.filter(F.col("kind").isin("class", "struct", "interface", "enum")).select("fq_name", "name").orderBy("fq_name").limit(most)
    head = c.select(F.lit(1).alias("part"), F.concat(F.lit("    class "), safe_id(F.col("fq_name")), F.lit('["'), "name", F.lit('"]')).alias("line"))
    own = members.join(c.select(F.col("fq_name").alias("owner")), "owner", "left_semi").join(g.symbols.select("fq_name", "name", "kind"), "fq_name")
    call = F.when(F.col("kind").isin("method", "constructor"), "()").otherwise("")
    rows = own.select(F.lit(2).alias("part"), F.concat(F.lit("    "), safe_id(F.col("owner")), F.lit(" : "), "name", call).alias("line"))
    shown = c.select("fq_name")
    up = g.of_type("inherits", "implements").join(shown.withColumnRenamed("fq_name", "source"), "source", "left_semi").join(shown.withColumnRenamed("fq_name", "target"), "target", "left_semi")
    arrow = F.when(F.col("edge_type") == "implements", " <|.. ").otherwise(" <|-- ")
    return head.unionByName(rows).unionByName(up.select(F.lit(3).alias("part"), F.concat(F.lit("    "), safe_id(F.col("target")), arrow, safe_id(F.col("source"))).alias("line")))


def document(lines: DataFrame, first: str) -> str:
    return "\n".join([first, *(r.line for r in lines.orderBy(*[c for c in ("part", "line") if c in lines.columns]).toLocalIterator())])


def prometheus_lines(counts: DataFrame, durations: DataFrame, prefix: str = "weftgraph") -> DataFrame:
    """(line) of counters (route, status, n) and of latencies (route, n, total, p50, p99) in the text format."""
    label = F.concat(F.lit('{route="'), "route", F.lit('"'))
    total = counts.select(F.concat(F.lit(f"{prefix}_requests_total"), label, F.lit(',status="'), "status", F.lit('"} '), F.col("n").cast("string")).alias("line"))
    name = f"{prefix}_request_duration_seconds"
    each = F.array(
        F.concat(F.lit(name), label, F.lit(',quantile="0.5"} '), F.format_string("%.6f", "p50")), F.concat(F.lit(name), label, F.lit(',quantile="0.99"} '), F.format_string("%.6f", "p99")),
        F.concat(F.lit(name + "_count"), label, F.lit("} "), F.col("n").cast("string")), F.concat(F.lit(name + "_sum"), label, F.lit("} "), F.format_string("%.6f", "total")),
    )
    return total.unionByName(durations.select(F.explode(each).alias("line")))


def markdown_summary(findings: DataFrame) -> DataFrame:
    """(line) of a table of findings by severity."""
    return severity_table(findings.groupBy("severity").agg(F.count("*").alias("n")))


def severity_table(counts: DataFrame) -> DataFrame:
    """The same from the numbers of findings (severity, n)."""
    return counts.select(F.concat(F.lit("| "), "severity", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line"))


def markdown_report(findings: DataFrame, complexity: DataFrame, title: str = "Code health", top: int = 30, complex_top: int = 15) -> str:
    """A report: counts by severity, the first findings by severity, and the most complex functions."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    counts = {r.severity: r.n for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    out = [f"# {title}", "", "| Severity | Findings |", "|---|---|", *[f"| {s} | {counts.get(s, 0)} |" for s in SEVERITIES], "", "## Findings", ""]
    out += [f"- **{r.rule_id}** {r.symbol_fq_name} ({r.file_path}:{r.line})" for r in findings.orderBy(rank, "file_path", "line", "rule_id").limit(top).collect()]
    out += ["", "## Complex functions", ""]
    out += [f"- {r.fq_name}: {r.cyclomatic_complexity}" for r in complexity.orderBy(F.desc("cyclomatic_complexity"), "fq_name").limit(complex_top).collect()]
    return "\n".join(out) + "\n"


def write_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV files in a folder of its own, with a header."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def csv_zip(tables: dict[str, DataFrame]) -> bytes:
    """One ZIP of a CSV a table, written row by row. For reports; write_csv is for tables of any size."""
    import csv

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            with z.open(f"{name}.csv", "w") as raw, io.TextIOWrapper(raw, "utf-8", newline="") as text:
                w = csv.writer(text)
                w.writerow(df.columns)
                for row in df.toLocalIterator():
                    w.writerow(["" if v is None else v for v in row])
    return out.getvalue()


def json_export(g: CodeGraph, summaries: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """(section, place, json): everything of a snapshot, a JSON object a row, symbols in order of file.

    Sections are symbols, edges, summaries (scope_type, scope_id, summary_json) and docs (doc_type, title,
    scope_id, markdown), and metadata: their counts. A summary that is no JSON is an empty one. Absent texts are empty.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    row = lambda section, place, *cols: (F.lit(section).alias("section"), place.alias("place"), F.to_json(F.struct(*cols)).alias("json"))
    mods = F.coalesce(F.array_join("modifiers", ","), F.lit("")).alias("modifiers")
    named = [text(c) for c in ("namespace", "parent_fq_name", "signature")]
    out = [
        g.symbols.select(*row("symbols", text("file_path"), "fq_name", "name", "kind", "file_path", "start_line", "end_line", *named, mods, text("return_type"))),
        g.edges.select(*row("edges", text("file_path"), F.col("source").alias("source_fq_name"), F.col("target").alias("target_fq_name"), "edge_type", text("file_path"), F.coalesce("line", F.lit(0)).alias("line"))),
    ]
    if summaries is not None:
        said = F.coalesce(F.try_parse_json("summary_json"), F.parse_json(F.lit("{}"))).alias("summary")
        out.append(summaries.select(*row("summaries", text("scope_id"), "scope_type", "scope_id", said)))
    if docs is not None:
        out.append(docs.select(*row("docs", text("scope_id"), "doc_type", "title", "scope_id", "markdown")))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    counts = whole.agg(*[F.count_if(F.col("section") == s).alias(c) for s, c in (("symbols", "symbol_count"), ("edges", "edge_count"), ("summaries", "summary_count"), ("docs", "doc_count"))])
    return whole.unionByName(counts.select(*row("metadata", F.lit(""), "symbol_count", "edge_count", "summary_count", "doc_count")))


def write_json(rows: DataFrame, folder: str) -> None:
    """json_export's rows as JSON lines, a folder a section, in order of place."""
    order = ("section", "place", "json")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("section", F.col("json").alias("value")).write.mode("overwrite").option("compression", "gzip").partitionBy("section").text(folder)


def write_graph(g: CodeGraph, folder: str, snapshot_id: str) -> None:
    """Symbols, edges and dependencies, partitioned by snapshot; a snapshot that is there is replaced."""
    for name, df in (("symbols", g.symbols), ("edges", g.edges), ("dependencies", g.dependencies)):
        if df is not None:
            df.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{folder}/{name}")


def read_graph(spark: SparkSession, folder: str, snapshot_id: str) -> CodeGraph:
    read = lambda name: spark.read.parquet(f"{folder}/{name}").filter(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")
    return CodeGraph(read("symbols"), read("edges"), read("dependencies"))


#: Short names of the portable form.
SHORT = {
    "symbols": {"fq_name": "fq", "name": "n", "kind": "k", "file_path": "f", "namespace": "ns", "parent_fq_name": "p", "start_line": "s", "end_line": "e", "signature": "sig", "return_type": "rt", "cyclomatic_complexity": "cc", "cognitive_complexity": "cog"},
    "edges": {"source": "s", "target": "t", "edge_type": "y", "file_path": "f", "line": "l"},
    "dependencies": {"name": "n", "version": "v", "ecosystem": "e", "file_path": "f", "is_dev": "d", "is_pinned": "p"},
}
SCHEMAS = {"symbols": SYMBOLS, "edges": EDGES, "dependencies": DEPENDENCIES}


#: The newest schema of the portable form, and the most bytes of an import.
PORTABLE_VERSION, MAX_IMPORT = 1, 200 * 1024 * 1024


def portable_reasons(files: DataFrame) -> DataFrame:
    """files (path, length, content) with `reason`: why a portable payload (gzip of one JSON object) is refused, else null.

    In this order: empty, too large, not gzip, not JSON, a newer schema version, no metadata. A file
    beyond the limit is refused by its length and not unpacked.
    """

    def judge(batches):
        for batch in batches:
            reasons = []
            for length, content in zip(batch.column("length").to_pylist(), batch.column("content").to_pylist()):
                reasons.append(_portable_reason(length, content))
            keep = [c for c in batch.schema.names if c != "content"]
            yield batch.select(keep).append_column("reason", pa.array(reasons, pa.string()))

    known = files.select("path", "length", F.when(F.col("length") <= MAX_IMPORT, F.col("content")).alias("content"))
    return known.mapInArrow(judge, known.drop("content").schema.add("reason", "string"))


def _portable_reason(length: int | None, content: bytes | None) -> str | None:
    if not length:
        return "empty"
    if length > MAX_IMPORT:
        return "too large"
    try:
        payload = json.loads(gzip.decompress(content))
    except (OSError, EOFError, zlib.error):
        return "not gzip"
    except ValueError:
        return "not JSON"
    if not isinstance(payload, dict):
        return "not JSON"
    version = payload.get("schema_version", 0)
    if not isinstance(version, int | float) or version > PORTABLE_VERSION:
        return "newer schema version"
    return None if "metadata" in payload else "no metadata"


def write_portable(g: CodeGraph, folder: str) -> None:
    """Compressed JSON lines with short keys; empty values are left out."""
    for name, df in (("symbols", g.symbols), ("edges", g.edges), ("dependencies", g.dependencies)):
        if df is None:
            continue
        cols = []
        for c, short in SHORT[name].items():
            if c in df.columns:
                v = F.col(c)
                cols.append((F.when(v == "", None).otherwise(v) if SCHEMAS[name][c].dataType.typeName() == "string" else v).alias(short))
        extra = [F.when(F.size("modifiers") > 0, F.array_join("modifiers", ",")).alias("m")] if name == "symbols" and "modifiers" in df.columns else []
        df.select(F.lit(1).alias("schema_version"), *cols, *extra).write.mode("overwrite").option("compression", "gzip").json(f"{folder}/{name}")


def read_portable(spark: SparkSession, folder: str) -> CodeGraph:
    """A portable snapshot, absent values filled with their defaults; a newer schema version is refused."""
    frames = {}
    for name, short in SHORT.items():
        kinds = ", ".join(f"{s} {SCHEMAS[name][c].dataType.simpleString()}" for c, s in short.items())
        raw = spark.read.schema(f"schema_version int, {kinds}" + (", m string" if name == "symbols" else "")).json(f"{folder}/{name}")
        raw = raw.withColumn("schema_version", F.when(F.col("schema_version") <= 1, F.col("schema_version")).otherwise(F.raise_error(F.lit("newer schema version"))))
        cols = [F.col("schema_version")]
        for c, s in short.items():
            kind = SCHEMAS[name][c].dataType.typeName()
            cols.append(F.coalesce(s, F.lit("")).alias(c) if kind == "string" and c != "parent_fq_name" else F.col(s).alias(c))
        if name == "symbols":
            cols.append(F.when(F.col("m").isNull(), F.array().cast("array<string>")).otherwise(F.split("m", ",")).alias("modifiers"))
        frames[name] = raw.select(*cols).filter("schema_version is not null").drop("schema_version")
    return CodeGraph(frames["symbols"], frames["edges"], frames["dependencies"])
