"""Generated documents as lines: every line is a row with its document, section and place.

A document's Markdown is its lines in order, so a module with very many members is never gathered
into one row. `markdown` writes them; `references` gives each document's citations without repeats.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import CodeGraph, checkpointed
from ..helpers import filled
from .metrics import fan, has_any, loc, module_of, modules

#: Sections of a module's and of the code base's documents, words of settings, types, and documents expected.
MODULE_SECTIONS = ("Overview", "Files", "Classes & Interfaces", "Public API", "Internal Details", "Dependencies")
README_SECTIONS = ("Overview", "Tech Stack", "Modules", "Entry Points", "Metrics", "Configuration", "Known Risks & Hotspots", "Dependencies")
FLOW_SECTIONS = ("Overview", "Execution Steps", "Entry Points / Callers", "Side Effects")
#: Of the code base's document, what the others take, under which heading.
TAKEN = {
    "architecture": {"Overview": "Architecture Overview", "Modules": "Module Map", "Dependencies": "Module Dependencies", "Entry Points": "Entry Points", "Metrics": "Code Metrics", "Known Risks & Hotspots": "Hotspots"},
    "runbook": {"Overview": "Overview", "Entry Points": "Entry Points", "Configuration": "Configuration", "Known Risks & Hotspots": "Known Risks & Hotspots"},
}
#: Sentences of documents, {} filled in order; words of names that write; steps of a flow.
SENTENCES = {"flow": "Call flow starting from `{}`.", "effect": "- `{}` may perform I/O or mutations.", "overview": "Codebase contains {} symbols ({}), {} relationships, and {} modules.", "module": "Module `{}` contains {} symbols across {} files."}
EFFECTS = ("write", "save", "delete", "send", "post", "log", "emit")
STEPS = 30
SETTINGS = ("config", "setting", "option", "startup")
TYPE_KINDS = ("class", "interface", "struct", "enum", "record", "delegate")
EXPECTED = ("readme", "architecture", "runbook")
#: How many lines a section of the code base's documents shows, and what counts as a risk.
SHOWN, EXTENSIONS, EXTERNAL, RISK_FAN_IN, RISK_LINES = 10, 5, 20, 5, 50


def extension_counts(g: CodeGraph, most: int | None = EXTENSIONS) -> DataFrame:
    """(extension, n): symbols by what follows the last point of their path, the commonest first; a top-k report unless most is None."""
    n = g.symbols.groupBy(F.substring_index(F.coalesce("file_path", F.lit("")), ".", -1).alias("extension")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension")
    return n.limit(most) if most else n


def kind_counts(g: CodeGraph) -> DataFrame:
    """(kind, n, place): symbols by kind, the commonest first."""
    n = g.symbols.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "kind")))  # one row a kind


def external_dependencies(g: CodeGraph) -> DataFrame:
    """(name): what modules import that is no module: targets' modules, or targets themselves where no symbol has the name."""
    known = g.symbols.select(F.col("fq_name").alias("target"), module_of("<root>").alias("module"))
    names = g.of_type("imports").select("target").distinct().join(known, "target", "left").select(F.coalesce("module", "target").alias("name")).unionByName((g.dependencies.select("name") if g.dependencies is not None else known.select(F.col("module").alias("name")).limit(0)))
    return names.distinct().join(known.select(F.col("module").alias("name")).distinct(), "name", "left_anti")


def missing_types(scopes: DataFrame, docs: DataFrame, expected: tuple[str, ...] = EXPECTED) -> DataFrame:
    """(scope, missing): the expected types of documents (scope, doc_type) that a scope lacks, in order of name."""
    have = docs.filter(F.col("doc_type").isin(*expected)).groupBy("scope").agg(F.collect_set("doc_type").alias("have"))
    want = F.array(*[F.lit(t) for t in sorted(expected)])
    return scopes.select("scope").distinct().join(have, "scope", "left").select("scope", F.array_except(want, F.coalesce("have", F.array().cast("array<string>"))).alias("missing"))


def _line(doc_type: str, scope: Column, sections: tuple[str, ...], heading: str, key: Column, text: Column) -> list[Column]:
    return [F.lit(doc_type).alias("doc_type"), scope.alias("scope"), F.lit(sections.index(heading)).alias("section"), F.lit(heading).alias("heading"), key.alias("key"), text.alias("line")]


def _code(c: str | Column) -> Column:
    return F.concat(F.lit("`"), c, F.lit("`"))


def flow_steps(g: CodeGraph, entries: DataFrame, steps: int = STEPS, most: int = 10) -> DataFrame:
    """entries (fq_name): (entry, node, depth), what each calls, directly or not, nearest first and then by name; at most `steps` rows an entry.

    All entries are walked at once. An entry that has its steps takes no part in further rounds, so what a
    round holds is bounded by the entries, however often a hub is called.
    """
    calls = checkpointed(g.of_type("calls").select(F.col("source").alias("node"), F.col("target").alias("to")).distinct())
    rounds = [checkpointed(entries.select(F.col("fq_name").alias("entry"), F.col("fq_name").alias("node"), F.lit(0).alias("depth")).distinct())]
    for depth in range(1, most + 1):
        so_far = reduce(DataFrame.unionByName, rounds)
        room = so_far.groupBy("entry").agg((F.lit(steps) - F.count("*")).alias("room")).filter("room > 0")
        new = rounds[-1].join(calls, "node").select("entry", F.col("to").alias("node")).distinct().join(so_far, ["entry", "node"], "left_anti").join(room, "entry")
        rank = F.row_number().over(Window.partitionBy("entry").orderBy("node"))
        rounds.append(checkpointed(new.withColumn("rank", rank).filter("rank <= room").select("entry", "node", F.lit(depth).alias("depth"))))
        if rounds[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, rounds)


def flow_documents(g: CodeGraph, entries: DataFrame, steps: int = STEPS, most: int = 10) -> DataFrame:
    """(doc_type, scope, section, heading, key, line): a document of the calls from every entry (fq_name). A section without lines is left out."""
    walked = checkpointed(flow_steps(g, entries, steps, most))
    scope = F.col("entry")
    line = lambda heading, key, text: _line("flow", scope, FLOW_SECTIONS, heading, key, text)
    s = g.symbols.select(F.col("fq_name").alias("node"), "kind", "file_path")
    key = F.concat(F.lpad(F.col("depth").cast("string"), 4, "0"), F.lit(" "), "node")
    step = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), _code("node"), F.lit(" ("), F.coalesce("kind", F.lit("?")), F.lit(") ["), F.coalesce("file_path", F.lit("")), F.lit("]"))
    first = walked.filter("depth = 0").select("entry")
    callers = g.of_type("calls").select(F.col("target").alias("entry"), F.col("source").alias("caller")).distinct().join(first, "entry", "left_semi")
    effect = F.lit(False)
    for w in EFFECTS:
        effect = effect | F.contains(F.lower("node"), F.lit(w))
    parts = [
        first.select(*line("Overview", F.lit(""), filled(SENTENCES["flow"], "entry"))),
        walked.join(s, "node", "left").select(*line("Execution Steps", key, step)),
        callers.select(*line("Entry Points / Callers", F.col("caller"), F.concat(F.lit("- "), _code("caller")))),
        walked.filter(effect).select(*line("Side Effects", key, filled(SENTENCES["effect"], "node"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def taken_from(readme_lines: DataFrame, doc_type: str) -> DataFrame:
    """The architecture document or the runbook: sections of the code base's document under their own headings and in their own order."""
    rows = []
    for k, (old, new) in enumerate(TAKEN[doc_type].items()):
        rows.append(readme_lines.filter(F.col("heading") == old).withColumns({"doc_type": F.lit(doc_type), "section": F.lit(k), "heading": F.lit(new)}))
    return reduce(DataFrame.unionByName, rows)


def module_documents(g: CodeGraph) -> DataFrame:
    """(doc_type, scope, section, heading, key, line): a document of every module, in one plan for all of them.

    Files, types and public members are a line each, in order of key; internal members are counted.
    A section without lines is left out.
    """
    s = g.symbols.withColumn("module", module_of("<root>"))
    scope = F.col("module")
    line = lambda heading, key, text: _line("module", scope, MODULE_SECTIONS, heading, key, text)
    m = modules(g)
    said = filled(SENTENCES["module"], "module", "symbol_count", "file_count")
    depends = m.select("module", F.explode(F.split("depends_on", ",")).alias("d")).filter("d <> ''")
    signature = F.coalesce(F.when(F.col("signature") != "", F.col("signature")), F.col("name"))
    public = has_any("public")
    internal = s.filter(~public & F.col("kind").isin("method", "property", "field")).groupBy("module").agg(F.count("*").alias("n"))
    parts = [
        m.select(*line("Overview", F.lit(""), said)),
        s.select("module", "file_path").distinct().select(*line("Files", F.col("file_path"), F.concat(F.lit("- "), _code("file_path")))),
        s.filter(F.col("kind").isin(*TYPE_KINDS)).select(*line("Classes & Interfaces", F.col("fq_name"), F.concat(F.lit("- **"), _code("fq_name"), F.lit("** ("), "kind", F.lit("): "), _code(signature)))),
        s.filter(public & F.col("kind").isin("method", "property")).select(*line("Public API", F.col("fq_name"), F.concat(F.lit("- "), _code(signature)))),
        internal.select(*line("Internal Details", F.lit(""), F.concat(F.col("n").cast("string"), F.lit(" internal members.")))),
        depends.select(*line("Dependencies", F.col("d"), F.concat(F.lit("- "), _code("d")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _top(df: DataFrame, most: int, *order) -> DataFrame:
    """The first rows with a key that sorts like them; a top-k report."""
    first = df.orderBy(*order).limit(most)
    return first.withColumn("key", F.lpad(F.row_number().over(Window.orderBy(*order)).cast("string"), 6, "0"))  # at most `most` rows


def readme(g: CodeGraph, roots: DataFrame) -> DataFrame:
    """(doc_type, scope, section, heading, key, line) of the code base's document; roots (fq_name, kind) are its entry points."""
    scope = F.lit("")
    line = lambda heading, key, text: _line("readme", scope, README_SECTIONS, heading, key, text)
    s = g.symbols.join(fan(g), "fq_name", "left").na.fill(0, ["fan_in", "fan_out"]).withColumn("lines", loc())
    kinds = kind_counts(g).agg(F.sum("n").alias("symbols"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "n", "kind"))), lambda x: F.concat(x.n.cast("string"), F.lit(" "), x.kind, F.lit("(s)"))), ", ").alias("kinds"))
    e, m = g.edges.agg(F.count("*").alias("edges")), modules(g)
    counts = kinds.crossJoin(e).crossJoin(m.agg(F.count("*").alias("modules")))  # one row each
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    overview = filled(SENTENCES["overview"], n("symbols"), F.coalesce("kinds", F.lit("")), n("edges"), n("modules"))
    first = F.array_join(F.slice(F.split("depends_on", ","), 1, 3), ", ")
    about = F.concat(F.lit("- **"), _code("module"), F.lit("** ("), n("symbol_count"), F.lit(" symbols, "), n("file_count"), F.lit(" files)"), F.when(F.col("depends_on") != "", F.concat(F.lit(" -> "), first)).otherwise(F.lit("")))
    measures = F.concat(F.lit("- "), _code("fq_name"), F.lit(": LOC="), n("lines"), F.lit(", fan-in="), n("fan_in"), F.lit(", fan-out="), n("fan_out"))
    risky = s.filter((F.col("fan_in") >= RISK_FAN_IN) | (F.col("lines") >= RISK_LINES))
    named = F.lit(False)
    for w in SETTINGS:
        named = named | F.contains(F.lower("name"), F.lit(w))
    by_use = (F.desc("fan_in"), F.desc("lines"), "fq_name")
    parts = [
        counts.select(*line("Overview", F.lit(""), overview)),
        _top(extension_counts(g, None), EXTENSIONS, F.desc("n"), "extension").select(*line("Tech Stack", F.col("key"), F.concat(F.lit("- **"), "extension", F.lit("**: "), n("n"), F.lit(" symbols")))),
        m.select(*line("Modules", F.col("module"), about)),
        roots.select(*line("Entry Points", F.col("fq_name"), F.concat(F.lit("- "), _code("fq_name"), F.lit(" ("), "kind", F.lit(")")))),
        _top(s, SHOWN, *by_use).select(*line("Metrics", F.col("key"), measures)),
        _top(s.filter(named), SHOWN, "fq_name").select(*line("Configuration", F.col("key"), F.concat(F.lit("- "), _code("fq_name"), F.lit(" in "), _code("file_path")))),
        _top(risky, SHOWN, *by_use).select(*line("Known Risks & Hotspots", F.col("key"), measures)),
        _top(external_dependencies(g), EXTERNAL, "name").select(*line("Dependencies", F.col("key"), F.concat(F.lit("- "), _code("name")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def references(g: CodeGraph) -> DataFrame:
    """(scope, line): the citations of module documents, once each: types and public members with their lines."""
    s = g.symbols.withColumn("module", module_of("<root>"))
    cited = s.filter(F.col("kind").isin(*TYPE_KINDS) | (has_any("public") & F.col("kind").isin("method", "property")))
    place = F.concat("file_path", F.when(F.col("start_line") > 0, F.concat(F.lit("#L"), F.col("start_line").cast("string"), F.when(F.col("kind").isin(*TYPE_KINDS) & (F.col("end_line") > 0) & (F.col("end_line") != F.col("start_line")), F.concat(F.lit("-L"), F.col("end_line").cast("string"))).otherwise(F.lit("")))).otherwise(F.lit("")))
    return cited.select(F.col("module").alias("scope"), F.concat(F.lit("["), _code("fq_name"), F.lit("]("), place, F.lit(")")).alias("line")).distinct()


def with_headings(lines: DataFrame) -> DataFrame:
    """lines and, under a null key, which sorts first, a heading of every section."""
    heads = lines.select("doc_type", "scope", "section", "heading").distinct()
    return lines.unionByName(heads.withColumns({"key": F.lit(None).cast("string"), "line": F.concat(F.lit("## "), "heading")}))


def markdown(lines: DataFrame, folder: str) -> None:
    """Documents as text, a folder a type, sorted by scope, section and key. Ranges end inside a long section, so no task holds a whole one."""
    order = ("doc_type", "scope", "section", "key")
    with_headings(lines).repartitionByRange(*order).sortWithinPartitions(*order, "line").select("doc_type", F.col("line").alias("value")).write.mode("overwrite").partitionBy("doc_type").text(folder)
