"""Checks of generated text against what is known, and sanitising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import checkpointed
from .search import BACKTICK, DOTTED
from .substring import holders, name_index

#: Patterns of prompt injection and of personal data, in order of replacement, and words that are no references.
INJECTION = {
    "ignore_previous": r"(?i)ignore\s+(all\s+)?previous\s+instructions",
    "role_override": r"(?i)you\s+are\s+now\s+(a|an)\s+",
    "system_prefix": r"(?i)system\s*:\s*",
    "rule_override": r"(?i)(do\s+not|don'?t)\s+(follow|obey|listen|use)\s+(your|the|any)\s+(rules|instructions|guidelines)",
    "persona_hijack": r"(?i)\bpretend\b.*\b(you are|to be)\b",
    "special_token": r"(?i)<\|.*?\|>",
    "llama_format": r"(?i)\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>",
}
PII = {
    "EMAIL": r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z]{2,}\b",
    "PHONE": r"\b(?:(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "API_KEY": r"\b(?:sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{36,}|AKIA[A-Z0-9]{16})\b",
}
COMMON_WORDS = ("The", "This", "That", "Not", "None", "True", "False", "Any", "All", "Type", "List", "Dict", "Set", "Int", "String", "Boolean")
_NAME = r"`?([A-Za-z_][\w.]*)`?"
CLAIMS = (rf"(?i){_NAME}\s+(?:calls|invokes|delegates to|sends to)\s+{_NAME}", rf"(?i){_NAME}\s+(?:inherits|extends|implements)\s+{_NAME}")


def injections(text: Column) -> Column:
    """Names of the injection patterns that occur."""
    text = F.coalesce(text, F.lit(""))
    return F.filter(F.array(*[F.when(text.rlike(p), n) for n, p in INJECTION.items()]), lambda x: x.isNotNull())


def redact(text: Column) -> Column:
    """Personal data replaced, one kind after the other."""
    return reduce(lambda t, kv: F.regexp_replace(t, kv[1], f"[{kv[0]}_REDACTED]"), PII.items(), text)


def sanitize_input(text: Column) -> Column:
    return redact(reduce(lambda t, p: F.regexp_replace(t, p, "[FILTERED]"), INJECTION.values(), text))


def output_check(texts: DataFrame) -> DataFrame:
    """texts (id, text): the redacted text's hash, whether it was clean, and its score."""
    clean = redact(F.col("text"))
    same = clean == F.col("text")
    return texts.select("id", F.sha2(clean.cast("binary"), 256).alias("text_sha256"), same.alias("passed"), F.when(same, 1.0).otherwise(0.5).alias("score"))


def references(text: Column) -> Column:
    """Names in backticks and dotted names, each once, but for short and common words."""
    found = lambda p: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1))
    return F.filter(F.array_distinct(F.concat(found(BACKTICK), found(DOTTED))), lambda r: (F.length(r) > 2) & ~r.isin(*COMMON_WORDS))


def unknown_references(texts: DataFrame, known: DataFrame) -> DataFrame:
    """texts (id, text) against known (name): (id, refs, unknown, score, severity).

    A reference is known if it is a name, lies inside one, or holds one.
    """
    refs = texts.select("id", F.explode(references(F.col("text"))).alias("ref"))
    names = known.select("name").filter("name <> ''").distinct()
    distinct = refs.select("ref").distinct()
    missing = checkpointed(distinct.join(names, distinct.ref == names.name, "left_anti"))
    inside = holders(missing, name_index(names)).select("ref")
    around = holders(names.select(F.col("name").alias("ref")), name_index(missing.select(F.col("ref").alias("name")))).select(F.col("name").alias("ref"))
    unknown = missing.join(inside.unionByName(around).distinct(), "ref", "left_anti").withColumn("bad", F.lit(1))
    counted = refs.join(unknown, "ref", "left").groupBy("id").agg(F.count("*").alias("refs"), F.coalesce(F.sum("bad"), F.lit(0)).alias("unknown"))
    all_ = texts.select("id").join(counted, "id", "left").na.fill(0, ["refs", "unknown"])
    ratio = F.when(F.col("refs") > 0, F.col("unknown") / F.col("refs")).otherwise(0.0)
    return all_.select("id", "refs", "unknown", F.round(1 - ratio, 6).alias("score"), F.when(F.col("unknown") == 0, "pass").when(ratio > 0.3, "fail").otherwise("warning").alias("severity"))


def claims(text: Column) -> Column:
    """(source, target) pairs that a text says are related."""
    found = lambda p, k: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(k))
    return F.concat(*[F.arrays_zip(found(p, 1).alias("source"), found(p, 2).alias("target")) for p in CLAIMS])


def unknown_claims(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """Claimed relationships that are no edge: (id, claims, unknown)."""
    said = texts.select("id", F.explode(claims(F.col("text"))).alias("c")).select("id", F.col("c.source"), F.col("c.target"))
    known = edges.select("source", "target").distinct().withColumn("known", F.lit(1))
    return said.join(known, ["source", "target"], "left").groupBy("id").agg(F.count("*").alias("claims"), F.count_if(F.col("known").isNull()).alias("unknown"))


def ratio_check(good: Column, total: Column, least: float, none: float) -> Column:
    """A struct (score, passed): good / total against a threshold; `none` (and passed) where there is nothing to check."""
    score = F.when(total > 0, good / total).otherwise(F.lit(none))
    return F.struct(F.round(score, 6).alias("score"), ((total == 0) | (score >= least)).alias("passed"))


#: Check -> (threshold, score where there is nothing to check).
RATIO_CHECKS = {
    "citation_coverage": (0.8, 0.5), "factual_grounding": (0.6, 0.7), "answer_completeness": (0.5, 1.0), "doc_completeness": (0.7, 1.0),
    "doc_symbol_accuracy": (0.6, 1.0), "doc_coverage": (0.5, 1.0), "review_precision": (0.7, 1.0), "review_coverage": (0.3, 1.0),
}


def severity_distribution(findings: DataFrame) -> DataFrame:
    """findings (review, severity): a review of three findings or more, all of one severity, does not pass."""
    g = findings.groupBy("review").agg(F.count("*").alias("findings"), F.count_distinct("severity").alias("severities"))
    return g.withColumn("passed", ~((F.col("findings") >= 3) & (F.col("severities") == 1)))


def rollup(checks: DataFrame) -> DataFrame:
    """checks (scope, name, score, severity, passed): mean score, worst severity, and up to three failed names."""
    rank = F.when(F.col("severity") == "fail", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    worst = F.max(rank)
    failed = F.slice(F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("name")))), 1, 3)
    return checks.groupBy("scope").agg(F.round(F.avg("score"), 6).alias("score"), F.when(worst == 2, "fail").when(worst == 1, "warning").otherwise("pass").alias("severity"), F.count_if("passed").alias("n_passed"), F.array_join(failed, ",").alias("failed"))


def trend(evaluations: DataFrame, band: float = 0.02) -> DataFrame:
    """evaluations (scope, at, score), the latest of each time: first and last score, change, and direction."""
    g = evaluations.groupBy("scope").agg(F.min_by("score", "at").alias("first"), F.max_by("score", "at").alias("last"), F.count("*").alias("points"))
    change = F.round(F.col("last") - F.col("first"), 4)
    return g.select("scope", "points", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), change.alias("change"), F.when(change > band, "improving").when(change < -band, "declining").otherwise("stable").alias("direction"))
