"""Checks that read answers, documents and reviews, and hold them against what a snapshot knows.

Each check is a frame (scope, name, total, good, score, passed, severity): what it counted, the
share that is good, and the verdict against its threshold. `RATIO_CHECKS` has the thresholds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guard import RATIO_CHECKS, ratio_check
from .search import BACKTICK
from .substring import holders, name_index

#: Types of documents that a snapshot should have.
DOC_TYPES = ("readme", "architecture", "runbook")
CHECK = ("scope", "name", "total", "good", "score", "passed", "severity")


def judged(counts: DataFrame, name: str) -> DataFrame:
    """counts (scope, total, good) as checks of that name."""
    least, none = RATIO_CHECKS[name]
    c = ratio_check(F.col("good"), F.col("total"), least, none)
    rows = counts.select("scope", F.lit(name).alias("name"), F.col("total").cast("long"), F.col("good").cast("long"), c.alias("c"))
    # an answer without citations passes with a warning
    calm = (F.col("total") > 0) if name == "citation_coverage" else F.lit(True)
    return rows.select("scope", "name", "total", "good", "c.score", "c.passed", F.when(F.col("c.passed") & calm, "pass").otherwise("warning").alias("severity"))


def contained(refs: DataFrame, names: DataFrame) -> DataFrame:
    """The refs (ref) that are, or lie inside, some name (name). Each once."""
    return holders(refs, name_index(names)).select("ref").distinct()


def backticks(text: Column) -> Column:
    """Names in backticks, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BACKTICK), F.lit(1)))


def _known_files(files: DataFrame) -> DataFrame:
    return files.select(F.col("path")).distinct()


def citation_coverage(answers: DataFrame, files: DataFrame) -> DataFrame:
    """answers (scope, citations): the share of cited paths that are files (path). An empty path counts as cited."""
    cited = answers.select("scope", F.explode("citations").alias("path"))
    known = _known_files(files).withColumn("known", F.lit(1))
    good = cited.join(known, "path", "left").groupBy("scope").agg(F.count("*").alias("total"), F.count("known").alias("good"))
    return judged(answers.select("scope").join(good, "scope", "left").na.fill(0), "citation_coverage")


def _grounded(texts: DataFrame, symbols: DataFrame, files: DataFrame, name: str) -> DataFrame:
    refs = texts.select("scope", F.explode(backticks(F.col("text"))).alias("ref"))
    there = contained(refs, symbols.select(F.col("fq_name").alias("name"))).unionByName(refs.select("ref").join(_known_files(files), F.col("ref") == F.col("path"), "left_semi")).distinct().withColumn("known", F.lit(1))
    counts = refs.join(there, "ref", "left").groupBy("scope").agg(F.count("*").alias("total"), F.count("known").alias("good"))
    return judged(texts.select("scope").join(counts, "scope", "left").na.fill(0), name)


def factual_grounding(texts: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """texts (scope, text): the share of names in backticks that are, or lie inside, a symbol's name, or are a file."""
    return _grounded(texts, symbols, files, "factual_grounding")


def doc_symbol_accuracy(texts: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """As factual_grounding, for documents."""
    return _grounded(texts, symbols, files, "doc_symbol_accuracy")


def _share(rows: DataFrame, items: str, hit, name: str) -> DataFrame:
    total = F.size(F.coalesce(items, F.array().cast("array<string>")))
    good = F.coalesce(F.size(F.filter(F.col(items), hit)), F.lit(0))
    return judged(rows.select("scope", total.alias("total"), F.greatest(good, F.lit(0)).alias("good")), name)


def answer_completeness(answers: DataFrame) -> DataFrame:
    """answers (scope, text, expected): the share of expected symbols whose name, or its last part, is in the text."""
    text = F.coalesce("text", F.lit(""))
    return _share(answers, "expected", lambda s: F.contains(text, s) | F.contains(text, F.substring_index(s, ".", -1)), "answer_completeness")


def doc_completeness(docs: DataFrame) -> DataFrame:
    """docs (scope, text, sections): the share of expected sections that occur, whatever their case."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return _share(docs, "sections", lambda s: F.contains(low, F.lower(s)), "doc_completeness")


def coverage(symbols: DataFrame, name: str) -> DataFrame:
    """symbols (scope, wanted, held): of the wanted ones, the share that is held. For documents and for reviews."""
    return judged(symbols.groupBy("scope").agg(F.count_if("wanted").alias("total"), F.count_if(F.col("wanted") & F.col("held")).alias("good")), name)


def review_precision(findings: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """findings (scope, file_path, symbol): the share whose file is known and whose symbol is, or lies inside, a known one; empty ones count as known."""
    f = findings.select("scope", F.coalesce("file_path", F.lit("")).alias("path"), F.coalesce("symbol", F.lit("")).alias("ref"))
    there = contained(f, symbols.select(F.col("fq_name").alias("name"))).withColumn("known", F.lit(1))
    paths = _known_files(files).withColumn("file_known", F.lit(1))
    good = ((F.col("path") == "") | F.col("file_known").isNotNull()) & ((F.col("ref") == "") | F.col("known").isNotNull())
    return judged(f.join(there, "ref", "left").join(paths, "path", "left").groupBy("scope").agg(F.count("*").alias("total"), F.count_if(good).alias("good")), "review_precision")


def _simple(rows: DataFrame, name: str, total: Column, good: Column, passed: Column) -> DataFrame:
    score = F.round(F.when(total > 0, good / total).otherwise(0.0), 6)
    return rows.select("scope", F.lit(name).alias("name"), total.cast("long").alias("total"), good.cast("long").alias("good"), score.alias("score"), passed.alias("passed"), F.when(passed, "pass").otherwise("warning").alias("severity"))


def doc_staleness(docs: DataFrame, current: DataFrame) -> DataFrame:
    """docs (scope, snapshot) against current (snapshot): whether each is of the current snapshot."""
    now = current.select("snapshot").distinct().withColumn("now", F.lit(1))
    fresh = docs.join(now, "snapshot", "left").select("scope", F.col("now").isNotNull().alias("fresh"))
    return _simple(fresh, "doc_staleness", F.lit(1), F.col("fresh").cast("int"), F.col("fresh"))


def docs_exist(snapshots: DataFrame, docs: DataFrame) -> DataFrame:
    """snapshots (scope) and docs (scope, doc_type): whether a snapshot has documents, and those of DOC_TYPES."""
    kinds = F.array(*[F.lit(t) for t in DOC_TYPES])
    held = docs.groupBy("scope").agg(F.count("*").alias("docs"), F.collect_set(F.when(F.col("doc_type").isin(*DOC_TYPES), F.col("doc_type"))).alias("types"))
    rows = snapshots.select("scope").distinct().join(held, "scope", "left").na.fill(0, ["docs"])
    types = F.size(F.array_intersect(F.coalesce("types", F.array().cast("array<string>")), kinds))
    some = F.col("docs") > 0
    exist = _simple(rows, "docs_exist", F.lit(1), some.cast("int"), some)
    return exist.unionByName(_simple(rows.filter(some), "doc_types_present", F.lit(len(DOC_TYPES)), types, types == len(DOC_TYPES)))


def symbol_coverage(symbols: DataFrame) -> DataFrame:
    """symbols (scope, fq_name): whether a snapshot has symbols at all."""
    n = symbols.groupBy("scope").agg(F.count("*").alias("n"))
    return _simple(n, "symbol_coverage", F.lit(1), (F.col("n") > 0).cast("int"), F.col("n") > 0)


def composed(checks: list[DataFrame]) -> DataFrame:
    """Checks of several kinds as one frame, for `guard.rollup`."""
    return reduce(DataFrame.unionByName, [c.select(*CHECK) for c in checks])
