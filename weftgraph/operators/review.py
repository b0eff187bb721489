"""Unified diffs as rows, and what reviewing them needs.

A diff is split into lines, and its state (file, hunk, line numbers) is carried along by window
sums over each diff's lines: JVM expressions only. A diff is one document; its lines are sorted
in one partition, as the state of a line depends on all before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import CodeGraph, checkpointed

#: Patterns of the heuristics (Java syntax), each with the label that it gives.
VALIDATION = {
    "validation": r"(?i)\b(if\s*\(.*(?:null|empty|length|count|valid|check|assert|require|guard))", "argument_exception": r"(?i)\b(throw\s+new\s+Argument(?:Null)?Exception)",
    "exception": r"(?i)\b(ArgumentNullException|ArgumentException|InvalidOperationException)", "guard": r"(?i)\bGuard\.",
}
NULL_CHECK = {"not_null": r"!=\s*null", "null": r"==\s*null", "is_null": r"\bis\s+null\b", "is_not_null": r"\bis\s+not\s+null\b", "coalesce": r"\?\?", "access": r"\?\."}
ERROR_HANDLING = {"try": r"\b(try\s*\{)", "catch": r"\b(catch\s*\()", "finally": r"\b(finally\s*\{)", "handler": r"\b(\.Catch\(|\.OnError\()"}
SIDE_EFFECT = {
    "database write": r"\b(SaveChanges|SaveChangesAsync|ExecuteNonQuery)\b", "destructive operation": r"\b(Delete|Remove|Drop|Truncate)\s*\(", "external communication": r"\b(Send|Post|Put|Publish|Enqueue|Emit)\w*\s*\(",
    "file system write": r"\b(File\.Write|File\.Delete|File\.Move|Directory\.Delete)\b", "process execution": r"\b(Process\.Start|Runtime\.exec)\b",
}
CONCURRENCY = {
    "locking": r"\b(lock|Monitor\.Enter|Mutex|Semaphore|Interlocked)\b", "async pattern": r"\b(async|await|Task\.Run|Task\.Factory)\b", "static state": r"\b(static\s+(?!readonly\s+string|readonly\s+int).*=)",
    "concurrent collection": r"\b(ConcurrentDictionary|ConcurrentBag|ConcurrentQueue)\b",
}
SECURITY = {
    "secret": r"(?i)\b(password|secret|token|apikey|api_key|credential)\b", "auth attribute": r"\b(Authorize|AllowAnonymous|Authenticate)\b", "raw sql": r"\b(SqlCommand|SqlQuery|FromSqlRaw|ExecuteSqlRaw)\b",
    "security config": r"(?i)\b(HttpOnly|Secure|SameSite|CORS|AllowAny)\b", "cryptography": r"\b(Decrypt|Encrypt|Hash|HMAC|RSA|AES)\b",
}
CONDITION, RETURN = r"\b(if|else\s+if|while|switch)\s*\(", r"\breturn\b"


#: A review's summary.
SUMMARY, NO_CHANGES = "%d file(s) changed, +%d additions, -%d deletions, %d symbol(s) affected.", "Empty diff -- no changes detected."


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diffs (diff_id, diff) to lines: file, flags of the file, hunk, numbers in the new and old file, content, side.

    side is added, removed or context; a line's number in the file that lacks it is 0. Lines that
    begin with `---`, `+++` or `index ` are skipped wherever they stand.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("diff", r"\r?\n")).alias("pos", "raw"))
    so_far = Window.partitionBy("diff_id").orderBy("pos")
    header, hunk = r"^diff --git a/(.+?) b/(.+)$", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    is_file = F.col("raw").rlike(header)
    x = lines.withColumn("file_no", F.sum(is_file.cast("int")).over(so_far)).filter("file_no > 0")
    x = x.withColumn("skip", F.col("raw").rlike(r"^(index |---|\+\+\+|new file mode|deleted file mode|rename from |rename to |similarity index )"))
    # hunks are counted in the diff's order too, so that all later windows share one sort: by file, hunk and place
    x = x.withColumn("is_hunk", ~F.col("skip") & F.col("raw").rlike(hunk)).withColumn("hunks", F.sum(F.col("is_hunk").cast("int")).over(so_far))
    x = x.withColumn("hunk_no", F.col("hunks") - F.last(F.when(is_file, F.col("hunks")), True).over(so_far)).drop("hunks")
    in_hunk = Window.partitionBy("diff_id", "file_no", "hunk_no")
    mark, counted = F.substring("raw", 1, 1), F.expr("hunk_no > 0 and not is_hunk and not skip")
    x = x.withColumn("side", F.when(counted, F.when(mark == "+", "added").when(mark == "-", "removed").when(mark == " ", "context")))
    before = in_hunk.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda side: F.coalesce(F.sum((F.col("side") != side).cast("int")).over(before), F.lit(0))
    x = x.withColumns({"new_before": count("removed"), "old_before": count("added")})
    first = lambda g: F.max(F.when(F.col("is_hunk"), F.regexp_extract("raw", hunk, g).cast("int"))).over(in_hunk)
    x = x.withColumns({"old_start": first(1), "new_start": first(3)})
    whole = Window.partitionBy("diff_id", "file_no")
    pick = lambda p, g=1: F.max(F.when(F.col("raw").rlike(p), F.regexp_extract("raw", p, g))).over(whole)
    has = lambda p: F.max(F.col("raw").rlike(p)).over(whole)
    x = x.withColumns({
        "path": F.coalesce(pick(r"^rename to (.+)$"), pick(header, 2)), "old_path": F.coalesce(pick(r"^rename from (.+)$"), pick(header, 1)),
        "is_new": has("^new file mode"), "is_deleted": has("^deleted file mode"), "is_renamed": has("^rename (from|to) "),
    })
    x = x.filter("side is not null")
    return x.withColumns({"number": F.when(F.col("side") == "removed", 0).otherwise(F.col("new_start") + F.col("new_before")), "old_number": F.when(F.col("side") == "added", 0).otherwise(F.col("old_start") + F.col("old_before"))}).select(
        "diff_id", "path", "old_path", "is_new", "is_deleted", "is_renamed", "hunk_no", "pos", "side", F.col("number").cast("int").alias("number"), F.col("old_number").cast("int").alias("old_number"), F.expr("substring(raw, 2)").alias("content")
    )


#: Lines of one bucket of a file, for interval joins.
BUCKET = 256


def changed_symbols(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(diff_id, fq_name, added, removed, change_type): symbols whose lines a diff touches. An interval join within (file, bucket of lines)."""
    at = F.when(F.col("side") == "added", F.col("number")).otherwise(F.col("old_number"))
    touched = lines.filter("side <> 'context'").select("diff_id", F.col("path").alias("file_path"), "side", at.alias("at"), "is_new", "is_deleted").withColumn("bucket", F.floor(F.col("at") / BUCKET))
    s = symbols.filter("start_line <= end_line").select("fq_name", "file_path", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / BUCKET), F.floor(F.col("end_line") / BUCKET))).alias("bucket"))
    hit = touched.join(s, ["file_path", "bucket"]).filter("at between start_line and end_line")
    kind = F.when(F.max("is_new"), "added").when(F.max("is_deleted"), "deleted").otherwise("modified")
    return hit.groupBy("diff_id", "fq_name").agg(F.count_if(F.col("side") == "added").alias("added"), F.count_if(F.col("side") == "removed").alias("removed"), kind.alias("change_type"))


#: Fixed value: callers from which on a change of a symbol is a finding.
HIGH_FAN_IN = 5


def high_fan_in(changed: DataFrame, g: CodeGraph) -> DataFrame:
    """changed (diff_id, fq_name): findings of changed symbols that many calls lead to, in the columns of `findings`, with the callers."""
    callers = g.of_type("calls").groupBy(F.col("target").alias("fq_name")).agg(F.count("*").alias("callers")).filter(F.col("callers") >= HIGH_FAN_IN)
    places = g.symbols.select("fq_name", "file_path", "start_line")
    hit = changed.select("diff_id", "fq_name").distinct().join(callers, "fq_name").join(places, "fq_name")
    return hit.select("diff_id", F.lit("high_fan_in_change").alias("category"), F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.lit("high").alias("severity"), F.col("fq_name").alias("label"), "callers")


def report(diffs: DataFrame, g: CodeGraph, hops: int = 3) -> DataFrame:
    """diffs (diff_id, diff) reviewed: (diff_id, summary, changed, impacted, findings, high, risk_score, risk_level), one row a diff.

    Impact counts all symbols within the hops; a diff without files has the summary of an empty one.
    """
    lines = checkpointed(diff_lines(diffs))
    changed = checkpointed(changed_symbols(lines, g.symbols))
    some = lines.groupBy("diff_id").agg(F.count_distinct("path").alias("files"), F.count_if(F.col("side") == "added").alias("plus"), F.count_if(F.col("side") == "removed").alias("minus"))
    found = findings(lines).select("diff_id", "severity").unionByName(high_fan_in(changed, g).select("diff_id", "severity"))
    counted = found.groupBy("diff_id").agg(F.count("*").cast("int").alias("findings"), F.count_if(F.col("severity").isin("critical", "high")).cast("int").alias("high"))
    symbols = changed.groupBy("diff_id").agg(F.count("*").cast("int").alias("changed"))
    impacted = _impacted(changed, g, hops).groupBy("diff_id").agg(F.count("*").cast("int").alias("impacted"))
    out = diffs.select("diff_id")
    for df in (some, symbols, impacted, counted):
        out = out.join(df, "diff_id", "left")
    out = out.na.fill(0).withColumnRenamed("diff_id", "id")
    said = F.format_string(SUMMARY, "files", "plus", "minus", "changed")
    rows = risk(out.withColumn("summary", F.when(F.col("files") == 0, NO_CHANGES).otherwise(said)))
    return rows.select(F.col("id").alias("diff_id"), "summary", "changed", "impacted", "findings", "high", "risk_score", "risk_level")


def _impacted(changed: DataFrame, g: CodeGraph, hops: int) -> DataFrame:
    """(diff_id, fq_name): known symbols from which calls lead to a changed one within some hops, for all diffs at once.

    Each set of changed symbols is walked once, however many diffs have it, and each round is written once.
    """
    calls = checkpointed(g.of_type("calls").select(F.col("target").alias("fq_name"), F.col("source").alias("caller")).distinct())
    sets = changed.groupBy("diff_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("fq_name")), "\n"), 256).alias("set"))
    sets = checkpointed(sets)
    own = changed.join(sets, "diff_id").select("set", "fq_name").distinct()
    rounds = [checkpointed(own)]
    for _ in range(hops):
        new = rounds[-1].join(calls, "fq_name").select("set", F.col("caller").alias("fq_name")).distinct()
        rounds.append(checkpointed(new.join(reduce(DataFrame.unionByName, rounds), ["set", "fq_name"], "left_anti")))
        if rounds[-1].isEmpty():
            break
    found = reduce(DataFrame.unionByName, rounds[1:], rounds[0].limit(0)).join(g.symbols.select("fq_name"), "fq_name", "left_semi")
    return sets.join(found, "set").select("diff_id", "fq_name")


def _label(patterns: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for label, p in reversed(patterns.items()):
        out = F.when(F.col("content").rlike(p), label).otherwise(out)
    return out


#: category -> (side or None for both, patterns, severity by side)
LINE_HEURISTICS = {
    "removed_validation": ("removed", VALIDATION, "high"), "removed_null_check": ("removed", NULL_CHECK, "high"), "removed_error_handling": ("removed", ERROR_HANDLING, "high"),
    "new_side_effect": ("added", SIDE_EFFECT, "medium"), "concurrency_risk": ("added", CONCURRENCY, "medium"), "security_sensitive": (None, SECURITY, None),
}


def line_findings(lines: DataFrame) -> DataFrame:
    """Findings of single lines: all heuristics in one scan. (diff_id, path, line, category, severity, label, pos)."""
    cases = []
    for category, (side, patterns, severity) in LINE_HEURISTICS.items():
        label = _label(patterns)
        when = label.isNotNull() & (F.col("side") == side if side else F.col("side") != "context")
        level = F.lit(severity) if severity else F.when(F.col("side") == "removed", "high").otherwise("medium")
        cases.append(F.when(when, F.struct(F.lit(category).alias("category"), level.alias("severity"), label.alias("label"))))
    at = F.when(F.col("side") == "removed", F.col("old_number")).otherwise(F.col("number")).alias("line")
    return lines.select("diff_id", "path", at, "pos", F.inline(F.filter(F.array(*cases), lambda x: x.isNotNull())))


def paired_findings(lines: DataFrame, category: str, pattern: str, only_changed: bool) -> DataFrame:
    """The i-th removed line of a hunk with the i-th added one, of the lines that match: both sides' texts differ."""
    order = Window.partitionBy("diff_id", "path", "hunk_no", "side").orderBy("pos")
    x = lines.filter((F.col("side") != "context") & F.col("content").rlike(pattern)).withColumn("i", F.row_number().over(order))
    g = x.groupBy("diff_id", "path", "hunk_no", "i").agg(
        F.max(F.when(F.col("side") == "removed", F.trim("content"))).alias("old"), F.max(F.when(F.col("side") == "added", F.trim("content"))).alias("new"),
        F.max(F.when(F.col("side") == "added", F.col("number"))).alias("line"), F.max("pos").alias("pos"),
    )
    both = g.filter("old is not null and new is not null")
    both = both.filter("old <> new") if only_changed else both
    return both.select("diff_id", "path", "line", "pos", F.lit(category).alias("category"), F.lit("medium").alias("severity"), F.lit("changed").alias("label"))


def findings(lines: DataFrame) -> DataFrame:
    """All findings, one for each (category, file, line): the first in the diff."""
    every = line_findings(lines).unionByName(paired_findings(lines, "changed_condition", CONDITION, False)).unionByName(paired_findings(lines, "changed_return", RETURN, True))
    first = F.min_by(F.struct("severity", "label"), F.struct("pos", "label"))
    return every.groupBy("diff_id", "category", "path", "line").agg(first.alias("f")).select("diff_id", "category", "path", "line", "f.severity", "f.label")


def risk(counts: DataFrame) -> DataFrame:
    """counts (id, changed, impacted, findings, high): the score of capped terms, and its level."""
    term = lambda c, each, most: F.least(F.col(c) * each, F.lit(most))
    score = F.least(term("changed", 4, 20) + term("impacted", 3, 30) + term("findings", 5, 30) + term("high", 10, 20), F.lit(100))
    return counts.withColumn("risk_score", score).withColumn("risk_level", F.when(score >= 70, "critical").when(score >= 50, "high").when(score >= 25, "medium").otherwise("low"))
