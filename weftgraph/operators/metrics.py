"""Counts and metrics over symbols and edges. Names that no symbol has still count as callers and callees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import FUNCTIONS, CodeGraph


def loc() -> Column:
    return F.col("end_line") - F.col("start_line") + 1


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def has_any(*modifiers: str) -> Column:
    return F.arrays_overlap(F.coalesce("modifiers", F.array().cast("array<string>")), F.array(*[F.lit(m) for m in modifiers]))


def folder_of(path: Column, top: str = "") -> Column:
    at = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"^(.*)/[^/]*$", 1)
    return F.when(F.instr(F.replace(path, F.lit("\\"), F.lit("/")), "/") > 0, at).otherwise(F.lit(top))


def module_of(top: str = "") -> Column:
    """A symbol's namespace, else its folder (`top` for files in no folder)."""
    return F.when(F.coalesce("namespace", F.lit("")) != "", F.col("namespace")).otherwise(folder_of(F.col("file_path"), top))


def fan(g: CodeGraph) -> DataFrame:
    """(fq_name, fan_in, fan_out): distinct callers and callees of every name in a call. One shuffle."""
    ends = F.explode(F.array(F.struct(F.col("target").alias("fq_name"), F.col("source").alias("caller"), F.lit(None).cast("string").alias("callee")), F.struct(F.col("source").alias("fq_name"), F.lit(None).cast("string").alias("caller"), F.col("target").alias("callee"))))
    calls = g.of_type("calls").select("source", "target").distinct().select(ends.alias("e")).select("e.*")
    return calls.groupBy("fq_name").agg(F.count("caller").alias("fan_in"), F.count("callee").alias("fan_out"))


def with_fan(g: CodeGraph) -> DataFrame:
    return g.symbols.join(fan(g), "fq_name", "left").na.fill(0, ["fan_in", "fan_out"])


def overview(g: CodeGraph) -> DataFrame:
    """(item, n): symbols of each kind, all symbols, edges, and modules (distinct namespaces)."""
    s = g.symbols.select("kind", "namespace")
    kinds = s.groupBy(F.concat(F.lit("kind:"), "kind").alias("item")).agg(F.count("*").alias("n"))
    total = s.agg(F.count("*").alias("symbols"), F.count_distinct(F.when(F.col("namespace") != "", F.col("namespace"))).alias("modules"))
    totals = total.select(F.expr("stack(2, 'symbols', symbols, 'modules', modules) as (item, n)"))
    return kinds.unionByName(totals).unionByName(g.edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("item"), "n"))


def symbol_metrics(g: CodeGraph) -> DataFrame:
    children = g.of_type("contains").groupBy(F.col("source").alias("fq_name")).agg(F.count("*").alias("child_count"))
    return (
        with_fan(g).join(children, "fq_name", "left").na.fill(0, ["child_count"])
        .select("fq_name", "kind", "namespace", "file_path", loc().alias("lines"), "fan_in", "fan_out", "child_count", has_any("public").alias("is_public"), has_any("static").alias("is_static"))
    )


def hotspots(g: CodeGraph, min_fan_in: int = 3, min_lines: int = 50) -> DataFrame:
    return symbol_metrics(g).filter((F.col("fan_in") >= min_fan_in) & (F.col("lines") >= min_lines)).orderBy(F.desc("fan_in"), F.desc("lines"), "fq_name")


def notable(g: CodeGraph, limit: int = 20) -> DataFrame:
    """Symbols with three calls in or out, or thirty lines (end - start), by edges in; a top-k report."""
    calls = g.of_type("calls")
    into, out = calls.groupBy(F.col("target").alias("fq_name")).agg(F.count("*").alias("edges_in")), calls.groupBy(F.col("source").alias("fq_name")).agg(F.count("*").alias("edges_out"))
    rows = g.symbols.select("fq_name", (F.col("end_line") - F.col("start_line")).alias("span")).join(into, "fq_name", "left").join(out, "fq_name", "left").na.fill(0, ["edges_in", "edges_out"])
    return rows.filter("edges_in >= 3 or edges_out >= 3 or span >= 30").orderBy(F.desc("edges_in"), "fq_name").limit(limit)


def complexity_report(g: CodeGraph, min_cc: int = 1) -> DataFrame:
    """One row: functions at or above min_cc, mean, the most complex, and how many are beyond 15 and 20."""
    f = g.symbols.filter(F.col("kind").isin(*FUNCTIONS) & (F.col("cyclomatic_complexity") >= min_cc))
    cc, cog = F.col("cyclomatic_complexity"), F.col("cognitive_complexity")
    return f.agg(
        F.count("*").alias("functions"), F.round(F.avg(cc), 6).alias("avg_cyclomatic"), F.round(F.avg(cog), 6).alias("avg_cognitive"), F.max(cc).alias("max_cyclomatic"),
        F.min_by("fq_name", F.struct(-cc, F.col("fq_name"))).alias("most_complex"), F.count_if(cc > 15).alias("high_cyclomatic"), F.count_if(cog > 20).alias("high_cognitive"),
    )


def contributors(symbols: DataFrame) -> DataFrame:
    f = symbols.filter(F.col("kind").isin(*FUNCTIONS) & (F.coalesce("last_author", F.lit("")) != ""))
    return f.groupBy(F.col("last_author").alias("author")).agg(
        F.count("*").alias("functions"), F.count_distinct("file_path").alias("files"), F.array_join(F.array_sort(F.collect_set(module_of())), ",").alias("modules")
    )


def dependency_rollup(deps: DataFrame) -> DataFrame:
    return deps.groupBy("ecosystem").agg(
        F.count("*").alias("total"), F.count_if("is_pinned").alias("pinned"), F.count_if(~F.col("is_pinned")).alias("unpinned"), F.count_if("is_dev").alias("dev"), F.count_if(~F.col("is_dev")).alias("production")
    )


def modules(g: CodeGraph) -> DataFrame:
    """(module, file_count, symbol_count, depends_on): imports and calls that leave the module, as a sorted list."""
    s = g.symbols.select("fq_name", module_of("<root>").alias("module"), "file_path")
    counts = s.groupBy("module").agg(F.count_distinct("file_path").alias("file_count"), F.count("*").alias("symbol_count"))
    deps = g.of_type("imports").select(F.col("source").alias("module"), "target").join(s.select(F.col("fq_name").alias("target"), F.col("module").alias("to")), "target")
    deps = deps.filter("module <> to").groupBy("module").agg(F.array_join(F.array_sort(F.collect_set("to")), ",").alias("depends_on"))
    return counts.join(deps, "module", "left").withColumn("depends_on", F.coalesce("depends_on", F.lit("")))


def ends(g: CodeGraph, *columns: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Edges (of some kinds) with both ends' kind, parent, namespace or module, null where an end is no symbol: (source, target, edge_type, source_kind, target_kind, ...)."""
    values = {"kind": F.col("kind"), "parent": F.col("parent_fq_name"), "namespace": F.col("namespace"), "module": module_of()}
    e = (g.of_type(*kinds) if kinds else g.edges).select("source", "target", "edge_type")
    for end in ("source", "target"):
        e = e.join(g.symbols.select(F.col("fq_name").alias(end), *[values[c].alias(f"{end}_{c}") for c in columns]), end, "left")
    return e


def module_edges(e: DataFrame) -> DataFrame:
    """(a, b, n) of edges with their ends' modules: edges between modules with both ends known, counted; a and b may be equal."""
    known = e.select(F.col("source_module").alias("a"), F.col("target_module").alias("b")).filter("a <> '' and b <> ''")
    return known.groupBy("a", "b").agg(F.count("*").alias("n"))


def _module_edges(g: CodeGraph) -> DataFrame:
    return module_edges(ends(g, "module"))


def module_dependencies(g: CodeGraph) -> DataFrame:
    return _module_edges(g).filter("a <> b").select("a", "b")


def module_metrics(g: CodeGraph, edges: DataFrame | None = None) -> DataFrame:
    """Coupling, instability, abstractness, distance and cohesion of each module; shares are 0 where there is nothing to share.

    `edges` are the counted edges between modules, if they are at hand.
    An interface counts as a class and as abstract; any symbol with an abstract modifier adds
    to the abstract ones, so abstractness can exceed 1; an edge between modules counts in both.
    """
    s = g.symbols.select(module_of().alias("module"), "kind", "file_path", has_any("abstract").alias("abstract")).filter("module <> ''")
    interface = (F.col("kind") == "interface").cast("int")
    counts = s.groupBy("module").agg(
        F.count("*").alias("symbol_count"), F.count_distinct("file_path").alias("file_count"), F.count_if(F.col("kind").isin(*FUNCTIONS)).alias("method_count"),
        F.count_if(F.col("kind").isin("class", "struct", "enum", "record", "interface")).alias("class_count"), F.sum(interface + F.col("abstract").cast("int")).alias("abstract_count"),
    )
    sides = (_module_edges(g) if edges is None else edges).select(F.explode(F.expr("if(a = b, array(struct(a as module, 'intra' as side, a as other, n)), array(struct(a as module, 'out' as side, b as other, n), struct(b as module, 'in' as side, a as other, n)))")).alias("x")).select("x.*")
    links = sides.groupBy("module").agg(
        F.count_if(F.col("side") == "in").alias("afferent"), F.count_if(F.col("side") == "out").alias("efferent"),
        F.sum(F.when(F.col("side") == "intra", F.col("n")).otherwise(0)).alias("intra_edges"), F.sum(F.when(F.col("side") != "intra", F.col("n")).otherwise(0)).alias("inter_edges"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == "out", F.col("other")))), ",").alias("depends_on"),
    )
    m = counts.join(links, "module", "left").na.fill(0, ["afferent", "efferent", "intra_edges", "inter_edges"]).na.fill("", ["depends_on"])
    instability, abstractness = share(F.col("efferent"), F.col("afferent") + F.col("efferent")), share(F.col("abstract_count"), F.col("class_count"))
    return m.select(
        "*", F.round(instability, 6).alias("instability"), F.round(abstractness, 6).alias("abstractness"), F.round(F.abs(abstractness + instability - 1), 6).alias("distance"),
        F.round(share(F.col("intra_edges"), F.col("intra_edges") + F.col("inter_edges")), 6).alias("cohesion"),
    )


def coupling_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("modules"), *[F.round(F.avg(c), 3).alias(f"avg_{c}") for c in ("instability", "abstractness", "distance", "cohesion")])


def namespace_dependencies(g: CodeGraph) -> DataFrame:
    """Distinct pairs of namespaces that call, use or import each other's symbols."""
    return namespace_pairs(ends(g, "namespace", kinds=("calls", "uses", "imports")))


def namespace_pairs(e: DataFrame) -> DataFrame:
    """The same of edges with their ends' namespaces."""
    pairs = e.filter(F.col("edge_type").isin("calls", "uses", "imports")).select(F.col("source_namespace").alias("a"), F.col("target_namespace").alias("b"))
    return pairs.filter("a <> '' and b <> '' and a <> b").distinct()


def two_cycles(pairs: DataFrame) -> DataFrame:
    """(a, b) with a < b of which both directions are in pairs. One aggregation, no self-join."""
    both = pairs.distinct().groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).count()
    return both.filter("count = 2").select("a", "b")


def class_dependencies(g: CodeGraph) -> DataFrame:
    """Distinct pairs of parent classes joined by calls or uses; without a symbol, a name's parent is all but its last part."""
    return class_pairs(ends(g, "parent", kinds=("calls", "uses")))


def class_pairs(e: DataFrame) -> DataFrame:
    """The same of edges with their ends' parents."""
    cut = lambda c: F.when(F.instr(c, ".") > 0, F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)).otherwise(F.lit(""))
    of = lambda end: F.when(F.coalesce(f"{end}_parent", F.lit("")) != "", F.col(f"{end}_parent")).otherwise(cut(F.col(end)))
    pairs = e.filter(F.col("edge_type").isin("calls", "uses")).select(of("source").alias("a"), of("target").alias("b"))
    return pairs.filter("a <> '' and b <> '' and a <> b").distinct()


def children_of(g: CodeGraph) -> DataFrame:
    """Contained symbols as (owner, and the symbol's columns); names without a symbol are left out."""
    return g.of_type("contains").select(F.col("source").alias("owner"), F.col("target").alias("fq_name")).join(g.symbols, "fq_name")


def members_page(g: CodeGraph, per_class: int = 10) -> DataFrame:
    """The first members of each class by line and name, for diagrams."""
    from pyspark.sql import Window

    order = Window.partitionBy("owner").orderBy("start_line", "fq_name")
    return children_of(g).select("owner", "fq_name", "start_line", F.row_number().over(order).alias("row")).filter(F.col("row") <= per_class)


