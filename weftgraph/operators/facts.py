"""Facts of modules and files, texts for embedding, context of questions, and answers assembled from it.

Texts that users compare word for word are fixed values: SENTENCES.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import CodeGraph, checkpointed
from ..helpers import filled
from . import similarity
from .metrics import module_of
from .substring import holders, name_index

#: Sentences of facts, summaries and answers; {} are filled in order.
SENTENCES = {
    "module": "Module '{}' contains {} symbols across {} files.",
    "depends": " Depends on: {}.",
    "defines": "Defines {}.",
    "utility": "Utility file.",
    "symbol": "**{} `{}`**: declared in `{}` (lines {}-{}). Signature: `{}`.",
    "calls": "\n**Call relationships** ({} edges):",
    "call": "  - `{}` calls `{}`",
    "summaries": "\n**Related summaries** ({} found):",
    "summary": "  - [{}] {}",
    "nothing": "No relevant information found in the indexed codebase for this question. Try rephrasing, or ensure the target snapshot has been fully ingested and analysed.",
}
#: Most rows of each kind in a question's context, and of what an answer shows.
MOST_SYMBOLS, MOST_EDGES, SHOWN_EDGES, SHOWN_SUMMARIES, SHOWN_TEXT, MOST_RELATED = 20, 30, 10, 5, 200, 20
MOST_VECTORS, SHOWN_REFS, SHOWN_REVIEWS, MOST_CHECKS = 10, 2, 3, 7
#: What to check of an answer to a kind of question, and how.
VERIFICATION = {
    "impact": (("Verify all listed callers are still active", "Search for usages of the target symbol in the IDE"), ("Check for indirect callers via interfaces or reflection", "Search for the interface type in the codebase")),
    "flow": (("Verify the call chain by stepping through with a debugger", "Set breakpoints at each listed method and trigger the flow"),),
    "component": (("Verify the component's behaviour matches the description", "Read the source code at the cited file and line range"),),
}


def said(name: str, *values: str | Column) -> Column:
    """One of SENTENCES with its gaps filled; null if any value is."""
    return filled(SENTENCES[name], *values)


def module_facts(modules: DataFrame, g: CodeGraph) -> DataFrame:
    """modules (module, symbol_count, file_count, depends_on): (module, purpose, key_classes, responsibility, confidence)."""
    key = g.symbols.filter(F.col("kind").isin("class", "interface")).groupBy(module_of().alias("module")).agg(F.array_sort(F.collect_list("fq_name")).alias("key_classes"))
    deps = F.filter(F.split("depends_on", ","), lambda d: d != "")
    purpose = F.concat(said("module", "module", "symbol_count", "file_count"), F.when(F.size(deps) > 0, said("depends", F.array_join(F.slice(deps, 1, 5), ", "))).otherwise(""))
    m = modules.join(key, "module", "left").withColumn("key_classes", F.coalesce("key_classes", F.array().cast("array<string>")))
    return m.select("module", purpose.alias("purpose"), "key_classes", F.concat(F.lit("Defines "), F.size("key_classes").cast("string"), F.lit(" types")).alias("responsibility"), F.when(F.col("symbol_count") > 0, "high").otherwise("low").alias("confidence"))


def file_facts(g: CodeGraph) -> DataFrame:
    """(path, purpose, symbols, imports, confidence) of every file that symbols or imports name."""
    order = F.struct("start_line", "fq_name", "name")
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin("class", "interface", "struct"), order))), lambda s: s["name"])
    s = g.symbols.groupBy(F.col("file_path").alias("path")).agg(named.alias("types"), F.count("*").alias("symbols"), F.min("namespace").alias("space"))
    i = g.of_type("imports").groupBy(F.col("file_path").alias("path")).agg(F.count_distinct("target").alias("imports"))
    f = s.join(i, "path", "full").na.fill(0, ["symbols", "imports"])
    types = F.coalesce("types", F.array().cast("array<string>"))
    purpose = F.when(F.size(types) > 0, said("defines", F.array_join(types, ", "))).otherwise(SENTENCES["utility"])
    purpose = F.concat(F.when(F.coalesce("space", F.lit("")) != "", F.concat(F.lit("["), "space", F.lit("] "))).otherwise(""), purpose)
    return f.select("path", purpose.alias("purpose"), "symbols", "imports", F.when(F.col("symbols") > 0, "high").otherwise("low").alias("confidence"))


def summary_text(kind: Column, name: Column, purpose: Column, side_effects: Column, risks: Column, responsibilities: Column) -> Column:
    """A summary as one text for embedding: its parts with bars between; empty lists are left out."""
    listed = lambda title, items: F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.concat(F.lit(title), F.array_join(items, "; ")))
    return F.concat_ws(" | ", F.concat(kind, F.lit(": "), name), purpose, listed("Side effects: ", side_effects), listed("Risks: ", risks), listed("Responsibilities: ", responsibilities))


# ---- context of questions --------------------------------------------------------------------


def matched_symbols(questions: DataFrame, g: CodeGraph, most: int = MOST_SYMBOLS) -> DataFrame:
    """questions (id, target): the symbol of that full name; where none is, up to `most` that hold it or have it as name, by name."""
    s = g.symbols.select("fq_name", "name", "kind", "file_path", "start_line", "end_line", "signature")
    asked = questions.filter("target <> ''").select("id", "target")
    targets = checkpointed(asked.select("target").distinct())
    exact = targets.join(s, targets.target == s.fq_name)
    left = checkpointed(targets.join(s, targets.target == s.fq_name, "left_anti"))
    inside = holders(left.select(F.col("target").alias("ref")), name_index(s.select(F.col("fq_name").alias("name")))).select(F.col("ref").alias("target"), F.col("name").alias("fq_name"))
    named = left.join(s, left.target == s.name).select("target", "fq_name")
    rank = F.row_number().over(Window.partitionBy("target").orderBy("fq_name"))
    partly = inside.unionByName(named).distinct().withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank").join(s, "fq_name")
    return asked.join(exact.unionByName(partly.select(*exact.columns)), "target")


def call_context(questions: DataFrame, g: CodeGraph, most: int = MOST_EDGES) -> DataFrame:
    """questions (id, target, direction, max_hops): call edges around the target, hop by hop.

    A node matches every edge end that holds its name. A node gives at most `most` edges (least
    source, target and line first), and a question as many in all: (id, hop, source, target,
    file_path, line). Rounds are at most the hops asked for.
    """
    calls = checkpointed(g.of_type("calls").select("source", "target", "file_path", "line"))
    names = name_index(calls.select(F.col("source").alias("name")).unionByName(calls.select(F.col("target").alias("name"))))
    asked = checkpointed(questions.filter("target <> ''").select("id", F.col("target").alias("node"), "direction", "max_hops"))
    frontier, rounds = asked, [asked.select("id", "node")]
    found = []
    hops = asked.agg(F.max("max_hops").alias("n")).first()["n"] or 0
    order = Window.partitionBy("node", "way").orderBy("source", "target", "line", "file_path")
    for hop in range(1, hops + 1):
        nodes = frontier.filter(F.col("max_hops") >= hop).select("id", "node", "direction")
        # what a node gives is found once, whichever questions ask; nodes of later hops are whole names, but hold in longer ones too
        ends = holders(nodes.select(F.col("node").alias("ref")), names).select(F.col("ref").alias("node"), F.col("name").alias("fq"))
        out = ends.join(calls.withColumn("fq", F.col("source")), "fq").select("node", F.lit("out").alias("way"), "source", "target", "file_path", "line")
        into = ends.join(calls.withColumn("fq", F.col("target")), "fq").select("node", F.lit("in").alias("way"), "source", "target", "file_path", "line")
        first = out.unionByName(into).distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")
        ways = F.when(F.col("direction") == "both", F.array(F.lit("out"), F.lit("in"))).otherwise(F.array("direction"))
        each = nodes.select("id", "node", F.explode(ways).alias("way")).join(first, ["node", "way"]).select("id", "node", "source", "target", "file_path", "line").distinct()
        each = each.withColumn("n", F.row_number().over(Window.partitionBy("id", "node").orderBy("source", "target", "line", "file_path"))).filter(F.col("n") <= most)
        new = checkpointed(each.select("id", F.lit(hop).alias("hop"), "node", "source", "target", "file_path", "line"))
        found.append(new)
        if hop < hops:
            reached = new.select("id", F.explode(F.array("source", "target")).alias("node")).distinct().join(reduce(DataFrame.unionByName, rounds), ["id", "node"], "left_anti")
            frontier = checkpointed(reached.join(asked.select("id", "direction", "max_hops"), "id"))
            rounds.append(frontier.select("id", "node"))
            if frontier.isEmpty():
                break
    if not found:
        return calls.limit(0).select(F.lit(0).cast(questions.schema["id"].dataType).alias("id"), F.lit(0).alias("hop"), "source", "target", "file_path", "line")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("hop", "node", "source", "target", "line", "file_path"))
    return reduce(DataFrame.unionByName, found).withColumn("n", rank).filter(F.col("n") <= most).drop("n", "node")


def direction_of(kind: Column) -> Column:
    """Which way calls are followed for a kind of question."""
    return F.when(kind.isin("flow", "component"), "out").when(kind == "impact", "in").otherwise("both")


#: What evidence and summaries cite.
REF = "struct<file_path:string,symbol:string,start_line:int,end_line:int>"


def related_summaries(questions: DataFrame, texts: DataFrame, modules: DataFrame | None = None, embed=None, most: int = MOST_VECTORS) -> DataFrame:
    """Summaries that a question (id, text, question_type) is answered with: (id, rank, scope_type, text, refs, stands_for).

    The `most` nearest of texts (key, scope_type, text, refs) by their vectors, all questions at once;
    for questions of architecture also the modules (name, text, refs) after these, by name: those that an
    answer shows, of which the last stands for the others too. `embed` makes a vector of a text column; the
    hash embedder unless another is given.
    """
    embed = embed or similarity.hash_embedding
    hits = similarity.nearest_many(texts.select(F.col("key").alias("id"), embed(F.col("text")).alias("vector")), questions.select("id", embed(F.coalesce("text", F.lit(""))).alias("vector")), most)
    found = hits.join(texts, F.col("other") == F.col("key")).select("id", "rank", "scope_type", "text", "refs")
    if modules is None:
        return found.withColumn("stands_for", F.lit(1))
    # of the modules an answer shows the first; the last shown stands for all that follow
    n = modules.count()
    top = modules.select("name", F.lit("module_summary").alias("scope_type"), "text", "refs").orderBy("name").limit(SHOWN_SUMMARIES)
    place = F.row_number().over(Window.partitionBy("scope_type").orderBy("name"))
    top = top.withColumn("at", place).withColumn("stands_for", F.when(F.col("at") == SHOWN_SUMMARIES, n - SHOWN_SUMMARIES + 1).otherwise(1))
    wide = questions.filter("question_type = 'architecture'").select("id", F.lit("module_summary").alias("scope_type"))
    listed = wide.join(top, "scope_type").select("id", (F.col("at") + most).alias("rank"), "scope_type", "text", "refs", "stands_for")
    return found.withColumn("stands_for", F.lit(1)).unionByName(listed)


def verification(kind: Column, symbols: Column) -> Column:
    """The list of what to check: by the kind of question, then the first symbols (fq_name, file_path, start_line)."""
    item = lambda what, how: F.struct(F.lit(what).alias("description"), F.lit(how).alias("how_to_verify"))
    none = F.array().cast("array<struct<description:string,how_to_verify:string>>")
    general = none
    for k, items in VERIFICATION.items():
        general = F.when(kind == k, F.array(*[item(*i) for i in items])).otherwise(general)

    def review(s):
        return F.struct(F.concat(F.lit("Review `"), s["fq_name"], F.lit("` in `"), s["file_path"], F.lit("`")).alias("description"), F.concat(F.lit("Open "), s["file_path"], F.lit(" at line "), s["start_line"].cast("string")).alias("how_to_verify"))

    return F.slice(F.concat(general, F.coalesce(F.transform(F.slice(symbols, 1, SHOWN_REVIEWS), review), none)), 1, MOST_CHECKS)


def answers(questions: DataFrame, symbols: DataFrame, edges: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """questions (id, question_type), their symbols, edges and summaries (id, rank, scope_type, text, refs): (id, answer_text, evidence, related, confidence, verification).

    `evidence` lists what was shown: symbols, calls and what summaries refer to, each with the reason;
    `verification` what is left to check. Confidence counts 2 for symbols and 1 each for edges, summaries
    and neighbours: 4 are high, 2 medium.
    """
    title = F.concat(F.upper(F.substring("kind", 1, 1)), F.expr("substring(kind, 2)"))
    line = said("symbol", title, "fq_name", "file_path", "start_line", "end_line", F.coalesce("signature", F.lit("N/A")))
    by_symbol = symbols.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("fq_name", "file_path", "start_line", "end_line", line.alias("line")))).alias("s"))
    order = F.struct("hop", "source", "target", F.col("line").alias("at"), "file_path")
    by_edge = edges.groupBy("id").agg(F.array_sort(F.collect_list(order)).alias("e"))
    q = questions.select("id", "question_type").join(by_symbol, "id", "left").join(by_edge, "id", "left")
    if summaries is not None:
        text = said("summary", F.coalesce("scope_type", F.lit("unknown")), F.substring(F.coalesce("text", F.lit("")), 1, SHOWN_TEXT))
        cited = F.slice(F.coalesce("refs", F.array().cast(f"array<{REF}>")), 1, SHOWN_REFS)
        q = q.join(summaries.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("line"), cited.alias("refs")))).alias("m"), F.sum("stands_for" if "stands_for" in summaries.columns else F.lit(1)).alias("n_summaries")), "id", "left")
    else:
        q = q.withColumn("m", F.lit(None).cast(f"array<struct<rank:int,line:string,refs:array<{REF}>>>")).withColumn("n_summaries", F.lit(0))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    strings, proofs = F.array().cast("array<string>"), F.array().cast("array<struct<file_path:string,symbol:string,start_line:int,end_line:int,relevance:string>>")
    q = q.withColumn("near", F.array_sort(F.array_distinct(F.flatten(F.coalesce(F.transform("e", lambda x: F.array(x["source"], x["target"])), F.array().cast("array<array<string>>"))))))
    shown = F.transform(F.slice("e", 1, SHOWN_EDGES), lambda x: F.concat(F.lit("  - `"), x["source"], F.lit("` calls `"), x["target"], F.lit("`")))
    parts = F.concat(
        F.coalesce(F.transform("s", lambda x: x["line"]), strings),
        F.when(size("e") > 0, F.concat(F.array(said("calls", size("e"))), shown)).otherwise(strings),
        F.when(size("m") > 0, F.concat(F.array(said("summaries", "n_summaries")), F.transform(F.slice("m", 1, SHOWN_SUMMARIES), lambda x: x["line"]))).otherwise(strings),
    )
    proof = lambda path, symbol, start, end, why: F.struct(path.alias("file_path"), symbol.alias("symbol"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), why.alias("relevance"))
    nothing, zero = F.lit(""), F.lit(0)
    of_edges = F.transform(F.filter(F.slice("e", 1, SHOWN_EDGES), lambda x: F.coalesce(x["file_path"], nothing) != ""), lambda x: proof(x["file_path"], nothing, F.coalesce(x["at"], zero), zero, F.concat(F.lit("Call from "), x["source"], F.lit(" to "), x["target"])))
    refs = F.filter(F.flatten(F.transform(F.slice("m", 1, SHOWN_SUMMARIES), lambda x: x["refs"])), lambda r: F.coalesce(r["file_path"], nothing) != "")
    evidence = F.concat(
        F.coalesce(F.transform("s", lambda x: proof(x["file_path"], x["fq_name"], x["start_line"], x["end_line"], F.lit("Direct symbol match"))), proofs),
        F.coalesce(of_edges, proofs),
        F.coalesce(F.transform(refs, lambda r: proof(r["file_path"], F.coalesce(r["symbol"], nothing), F.coalesce(r["start_line"], zero), F.coalesce(r["end_line"], zero), F.lit("Vector search match"))), proofs),
    )
    points = F.when(size("s") > 0, 2).otherwise(0) + F.when(size("e") > 0, 1).otherwise(0) + F.when(size("m") > 0, 1).otherwise(0) + F.when(F.size("near") > 0, 1).otherwise(0)
    related = F.slice(F.array_sort(F.array_distinct(F.concat(F.coalesce(F.transform("s", lambda x: x["fq_name"]), strings), F.slice("near", 1, 10)))), 1, MOST_RELATED)
    empty = F.size(parts) == 0
    return q.select(
        "id", F.when(empty, SENTENCES["nothing"]).otherwise(F.array_join(parts, "\n")).alias("answer_text"), evidence.alias("evidence"), related.alias("related"),
        F.when(empty, "low").when(points >= 4, "high").when(points >= 2, "medium").otherwise("low").alias("confidence"), verification(F.col("question_type"), F.col("s")).alias("verification"),
    )
