"""Search, question routing and extractive facts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..helpers import filled
from .metrics import has_any, loc, with_fan

#: Patterns of each kind of question, in the order in which ties are decided.
QUESTION_PATTERNS = {
    "architecture": (r"\barchitect", r"\bstructur", r"\borganiz", r"\blayer", r"\bmodul", r"\bnamespace", r"\boverall", r"\bhigh.?level", r"\bdesign"),
    "flow": (r"\bflow\b", r"\bwhat happens", r"\bcall chain", r"\bsequence", r"\bwhen .* (call|invok|trigger|click|submit)", r"\bstep.?by.?step", r"\bexecut", r"\bpipeline", r"\bprocess\b", r"\bdata flow"),
    "impact": (r"\bimpact", r"\bbreak", r"\baffect", r"\bdepend", r"\bchange.*what", r"\bwhat.*change", r"\bregress", r"\bblast.?radius", r"\bripple", r"\bside.?effect"),
    "component": (r"\bclass\b", r"\bmethod\b", r"\bfunction\b", r"\binterface\b", r"\bservice\b", r"\bcontroller\b", r"\bwhat does .* do", r"\bexplain\b", r"\bdescribe\b", r"\bpurpose of", r"\brole of"),
}
#: References in texts, keywords of side effects, and hops of a question.
BACKTICK, DOTTED, PASCAL = r"`([A-Za-z_][\w.]*)`", r"\b([A-Z][a-zA-Z0-9]*(?:\.[A-Z][a-zA-Z0-9]*)+)\b", r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"
WRITE_WORDS = ("write", "save", "delete", "remove", "send", "post", "update", "insert")
LOG_WORDS = ("log", "print", "trace", "console")
HOPS = {"impact": 3, "architecture": 1}
#: Sentences of a symbol's purpose; {} are filled in order.
FACTS = {
    "class": "Class '{}' with {} members.", "bases": " Implements/extends: {}.", "interface": "Interface '{}' defining a contract.", "constructor": "Constructor for '{}'.", "property": "Property '{}' of type {}.", "other": "{} '{}'.",
    "method": "Method '{}'", "returns": "returns {}", "takes": "takes {} parameter(s)", "calls": "calls {} other symbol(s)", "called": "called by {} symbol(s)",
}


def _like(column: str, q: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).ilike(f"%{q}%")


def _holds(column: str, q: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit(""))).contains(q.lower())


def symbol_score(q: str) -> Column:
    by_name = F.when(F.lower("name") == q.lower(), 10.0).when(_holds("name", q), 5.0).otherwise(0.0)
    score = by_name + F.when(_holds("fq_name", q), 3.0).otherwise(0.0) + F.when(_holds("namespace", q), 1.0).otherwise(0.0)
    return F.greatest(score, F.lit(0.1))


def search_symbols(symbols: DataFrame, q: str) -> DataFrame:
    """(id, title, score) of symbols whose name, full name, namespace or signature is like %q%."""
    hit = _like("name", q) | _like("fq_name", q) | _like("namespace", q) | _like("signature", q)
    return symbols.filter(hit).select(F.col("fq_name").alias("id"), F.col("name").alias("title"), symbol_score(q).alias("score"))


def search_texts(texts: DataFrame, q: str) -> DataFrame:
    """(id, title, score) of texts (id, title, body) that are like %q% in title or body; the title decides the score."""
    title = F.when(F.lower("title") == q.lower(), 10.0).when(_holds("title", q), 5.0).otherwise(0.1)
    return texts.filter(_like("title", q) | _like("body", q) | _like("id", q)).select("id", "title", title.alias("score"))


def search_all(parts: dict[str, DataFrame], limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of hits of several kinds, best first; ties by the kinds' order and then by id."""
    out = None
    for order, (kind, hits) in enumerate(parts.items()):
        rows = hits.select(F.lit(kind).alias("entity"), F.lit(order).alias("o"), "id", "title", "score")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.desc("score"), "o", "id").offset(offset).limit(limit).drop("o")


def full_text(symbols: DataFrame, q: str) -> DataFrame:
    """Symbols that hold every word of q, ranked by how often they do; names are cut at dots, underscores and humps."""
    words = sorted({w for w in q.lower().split() if w})
    spaced = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2")
    body = F.lower(F.concat_ws(" ", spaced("fq_name"), spaced("name"), spaced("signature")))
    tokens = F.filter(F.split(body, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    counts = [F.size(F.col("tokens")) - F.size(F.array_remove(F.col("tokens"), w)) for w in words]
    rows = symbols.select("fq_name", tokens.alias("tokens"))
    rank = F.lit(0)
    hit = F.lit(bool(words))
    for c in counts:
        rank, hit = rank + c, hit & (c > 0)
    return rows.filter(hit).select("fq_name", rank.cast("long").alias("rank"))


# ---- questions ------------------------------------------------------------------------------


def question_type(text: Column) -> Column:
    """The kind with most patterns that occur; ties go to the first kind; without any, general."""
    low = F.lower(F.coalesce(text, F.lit("")))
    points = {}
    for kind, patterns in QUESTION_PATTERNS.items():
        n = F.lit(0)
        for p in patterns:
            n = n + F.when(low.rlike(p), 1).otherwise(0)
        points[kind] = n
    most = F.greatest(*points.values())
    out = F.lit("general")
    for kind in reversed(list(points)):
        out = F.when((points[kind] == most) & (most > 0), kind).otherwise(out)
    return out


def question_target(text: Column) -> Column:
    """The symbol that a question names: in backticks, else the longest dotted name, else the first of several humps."""
    text = F.coalesce(text, F.lit(""))
    first = lambda p: F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(1)), F.lit(""))
    dotted = F.regexp_extract_all(text, F.lit(DOTTED), F.lit(1))
    longest = F.aggregate(dotted, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.when(first(BACKTICK) != "", first(BACKTICK)).when(longest != "", longest).otherwise(first(PASCAL))


def question_hops(kind: Column) -> Column:
    out = F.lit(2)
    for k, n in HOPS.items():
        out = F.when(kind == k, n).otherwise(out)
    return out


def questions(texts: DataFrame) -> DataFrame:
    """texts (id, text) with question_type, target_symbol and max_hops."""
    return texts.withColumn("question_type", question_type(F.col("text"))).withColumn("target_symbol", question_target(F.col("text"))).withColumn("max_hops", question_hops(F.col("question_type")))


# ---- facts ----------------------------------------------------------------------------------


def symbol_facts(g: CodeGraph) -> DataFrame:
    """(fq_name, purpose, n_effects, n_assumptions, n_risks, confidence) of every symbol."""
    calls = g.of_type("calls")
    low = F.lower("target")
    hits = lambda words: F.lit(False) if not words else F.when(low.rlike("|".join(words)), 1).otherwise(0)
    out = calls.groupBy(F.col("source").alias("fq_name")).agg(F.count("*").alias("callees"), F.sum(hits(WRITE_WORDS) + hits(LOG_WORDS)).alias("effects"))
    into = calls.groupBy(F.col("target").alias("fq_name")).agg(F.count("*").alias("callers"))
    kids = g.of_type("contains").groupBy(F.col("source").alias("fq_name")).agg(F.count("*").alias("children"))
    s = with_fan(g).join(out, "fq_name", "left").join(into, "fq_name", "left").join(kids, "fq_name", "left").na.fill(0, ["callees", "effects", "callers", "children"])
    kind = F.col("kind")
    params = F.size(F.coalesce("parameters", F.array().cast("array<string>")))
    bases = F.coalesce(F.array_join("base_types", ", ") if "base_types" in g.symbols.columns else F.lit(""), F.lit(""))
    fact = lambda part, *values: filled(FACTS[part], *values)
    method = F.concat_ws(
        ", ", fact("method", "name"), F.when(F.col("return_type") != "", fact("returns", "return_type")), F.when(params > 0, fact("takes", params)),
        F.when(F.col("callees") > 0, fact("calls", "callees")), F.when(F.col("callers") > 0, fact("called", "callers")),
    )
    purpose = (
        F.when(kind == "class", F.concat(fact("class", "name", "children"), F.when(bases != "", fact("bases", bases)).otherwise("")))
        .when(kind == "interface", fact("interface", "name"))
        .when(kind == "method", F.concat(method, F.lit(".")))
        .when(kind == "constructor", fact("constructor", F.when(F.coalesce("parent_fq_name", F.lit("")) != "", F.col("parent_fq_name")).otherwise(F.col("name"))))
        .when(kind == "property", fact("property", "name", F.when(F.col("return_type") != "", F.col("return_type")).otherwise("unknown")))
        .otherwise(fact("other", F.initcap("kind"), "name"))
    )
    yes = lambda c: F.when(c, 1).otherwise(0)
    points = yes(F.coalesce("signature", F.lit("")) != "") + yes((params > 0) | (F.col("return_type") != "")) + yes(F.coalesce("doc_comment", F.lit("")) != "") + yes(F.col("callees") + F.col("callers") > 0)
    effects = F.when(kind.isin("method", "constructor"), F.col("effects")).otherwise(0)
    assumptions = F.when(kind == "method", yes(params == 0) + yes(has_any("static") & (params > 0))).otherwise(0)
    risks = yes(F.col("fan_in") >= 5) + yes(F.col("fan_out") >= 5) + yes(loc() >= 50)
    return s.select(
        "fq_name", purpose.alias("purpose"), effects.cast("long").alias("n_effects"), assumptions.alias("n_assumptions"), risks.alias("n_risks"), F.when(points >= 3, "high").when(points >= 1, "medium").otherwise("low").alias("confidence")
    )
