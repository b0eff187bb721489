"""Queries of checks that read texts, of reviews of whole diffs, and of facts, context and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, facts, guard, metrics, review, search
from ..sources import starschema
from ..sources.starschema import table
from .graph_queries import MODULE
from .registry import query

# ---- checks of answers, documents and reviews --------------------------------------------------

#: One answer a part: names in backticks, cited paths, and the symbols that it should name.
ANSWER = """ans AS (SELECT p_partkey AS scope, '`S' || (p_partkey % 150) || '` uses `' || replace(p_name, ' ', '.') || '` and `p' || p_partkey || '` of ' || p_brand AS text, ['S' || (p_partkey % 150), replace(p_name, ' ', '.'), 'p' || p_partkey] AS refs,
  CASE p_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN [path] WHEN 2 THEN [path, 'gone/x.py'] ELSE [path, path, path, path, ''] END::VARCHAR[] AS cites, CASE WHEN p_partkey % 7 = 0 THEN [] ELSE [mfq, 'x.' || p_brand, 'x.absent'] END::VARCHAR[] AS expected FROM mem),
"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, tick = F.col("p_partkey"), F.lit("`")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    s = starschema.symbols(spark, sf_dir).filter("parent_fq_name is not null").select(F.col("fq_name").alias("fq"), F.col("file_path").alias("path"), F.regexp_extract("fq_name", r"\.p(\d+)$", 1).try_cast("long").alias("p_partkey"))
    text = F.concat(tick, F.lit("S"), (key % 150).cast("string"), F.lit("` uses `"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("` and `p"), key.cast("string"), F.lit("` of "), "p_brand")
    none = F.array().cast("array<string>")
    cites = F.when(key % 4 == 0, none).when(key % 4 == 1, F.array("path")).when(key % 4 == 2, F.array(F.col("path"), F.lit("gone/x.py"))).otherwise(F.array("path", "path", "path", "path", F.lit("")))
    expected = F.when(key % 7 == 0, none).otherwise(F.array(F.col("fq"), F.concat(F.lit("x."), "p_brand"), F.lit("x.absent")))
    return p.join(s, "p_partkey").select(key.alias("scope"), text.alias("text"), cites.alias("citations"), expected.alias("expected"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starschema.symbols(spark, sf_dir).select(F.col("file_path").alias("path")).distinct()


def _judged(name: str, counts: str) -> str:
    """SQL of checks from counts (scope, total, good)."""
    least, none = guard.RATIO_CHECKS[name]
    passed = f"(total = 0 OR good::DOUBLE / total >= {least})"
    calm = f"{passed} AND total > 0" if name == "citation_coverage" else passed
    return f"""SELECT scope, '{name}' AS name, total::BIGINT AS total, good::BIGINT AS good, round(CASE WHEN total > 0 THEN good::DOUBLE / total ELSE {none} END, 6) AS score, {passed} AS passed, CASE WHEN {calm} THEN 'pass' ELSE 'warning' END AS severity FROM ({counts})"""


GROUNDED = """ref AS (SELECT scope, unnest(list_distinct(refs)) AS r FROM ans), there AS (SELECT r FROM (SELECT DISTINCT r FROM ref) d WHERE EXISTS (SELECT 1 FROM sym WHERE contains(fq_name, r))),
grounded AS (SELECT scope, count(*) AS total, count(there.r) AS good FROM ref LEFT JOIN there ON there.r = ref.r GROUP BY scope)
"""


@query("WITH " + ANSWER + "known AS (SELECT DISTINCT file_path FROM sym) " + _judged("citation_coverage", "SELECT scope, len(cites) AS total, (SELECT count(*) FROM (SELECT unnest(cites) AS c) u WHERE c IN (SELECT file_path FROM known)) AS good FROM ans"))
def check_citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.citation_coverage(_answers(spark, sf_dir), _files(spark, sf_dir))


@query("WITH " + ANSWER + GROUNDED + _judged("factual_grounding", "SELECT * FROM grounded"))
def check_factual_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.factual_grounding(_answers(spark, sf_dir), starschema.symbols(spark, sf_dir), _files(spark, sf_dir))


COMPLETE = "SELECT scope, len(expected) AS total, len(list_filter(expected, lambda s: contains(text, s) OR contains(text, split_part(s, '.', -1)))) AS good FROM ans"


@query("WITH " + ANSWER.rstrip().rstrip(",") + " " + _judged("answer_completeness", COMPLETE))
def check_answer_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.answer_completeness(_answers(spark, sf_dir))


#: Sections that every document of the corpus is held against.
SECTIONS = ("the", "License", "der", "los", "|", "no such section")
_SECTIONS = ", ".join(f"'{s.lower()}'" for s in SECTIONS)


@query(_judged("doc_completeness", f"SELECT doc_id AS scope, {len(SECTIONS)} AS total, len(list_filter([{_SECTIONS}], lambda s: contains(lower(text), s))) AS good FROM documents"), prelude=False)
def check_doc_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scope"), "text", F.array(*[F.lit(s) for s in SECTIONS]).alias("sections"))
    return evaluate.doc_completeness(d)


@query("WITH " + ANSWER + GROUNDED + _judged("doc_symbol_accuracy", "SELECT * FROM grounded"))
def check_doc_symbol_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.doc_symbol_accuracy(_answers(spark, sf_dir), starschema.symbols(spark, sf_dir), _files(spark, sf_dir))


@query("SELECT doc_id AS scope, 'doc_staleness' AS name, 1::BIGINT AS total, (source = 'src0')::BIGINT AS good, (source = 'src0')::DOUBLE AS score, source = 'src0' AS passed, CASE WHEN source = 'src0' THEN 'pass' ELSE 'warning' END AS severity FROM documents", prelude=False)
def check_doc_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their source as snapshot; the first one is the current one."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scope"), F.col("source").alias("snapshot"))
    return evaluate.doc_staleness(d, spark.createDataFrame([("src0",)], "snapshot string"))


@query("WITH x AS (SELECT namespace AS scope, count(*) FILTER (contains(mods, 'public')) AS total, count(*) FILTER (contains(mods, 'public') AND doc_comment <> '') AS good FROM sym GROUP BY 1) " + _judged("doc_coverage", "SELECT * FROM x"))
def check_doc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = starschema.symbols(spark, sf_dir)
    return evaluate.coverage(s.select(F.col("namespace").alias("scope"), metrics.has_any("public").alias("wanted"), (F.col("doc_comment") != "").alias("held")), "doc_coverage")


@query("WITH x AS (SELECT namespace AS scope, count(*) FILTER (fq_name IN (SELECT target FROM edge WHERE edge_type = 'calls')) AS total, count(*) FILTER (fq_name IN (SELECT target FROM edge WHERE edge_type = 'calls') AND cc > 15) AS good FROM sym GROUP BY 1) " + _judged("review_coverage", "SELECT * FROM x"))
def check_review_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each module's called symbols, which stand for changed ones, those with a finding: high complexity."""
    g = starschema.graph(spark, sf_dir)
    called = g.of_type("calls").select(F.col("target").alias("fq_name")).distinct().withColumn("wanted", F.lit(True))
    s = g.symbols.join(called, "fq_name", "left")
    return evaluate.coverage(s.select(F.col("namespace").alias("scope"), F.coalesce("wanted", F.lit(False)).alias("wanted"), (F.col("cyclomatic_complexity") > 15).alias("held")), "review_coverage")


FOUND = """fnd AS (SELECT p_brand AS scope, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'gone/x.py' ELSE path END AS path, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'p' || p_partkey ELSE 'no.' || p_name END AS ref FROM mem),
okref AS (SELECT ref FROM (SELECT DISTINCT ref FROM fnd) d WHERE ref = '' OR EXISTS (SELECT 1 FROM sym WHERE contains(fq_name, ref))), kf AS (SELECT DISTINCT file_path FROM sym) """


@query("WITH " + FOUND + _judged("review_precision", "SELECT scope, count(*) AS total, count(*) FILTER ((path = '' OR path IN (SELECT file_path FROM kf)) AND ref IN (SELECT ref FROM okref)) AS good FROM fnd GROUP BY 1"))
def check_review_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding a part, one review a brand."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    s = starschema.symbols(spark, sf_dir).filter("parent_fq_name is not null").select("file_path", F.regexp_extract("fq_name", r"\.p(\d+)$", 1).try_cast("long").alias("p_partkey"))
    size = F.col("p_size")
    path = F.when(size % 4 == 0, "").when(size % 4 == 1, "gone/x.py").otherwise(F.col("file_path"))
    symbol = F.when(size % 3 == 0, "").when(size % 3 == 1, F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("no."), "p_name"))
    f = p.join(s, "p_partkey").select(F.col("p_brand").alias("scope"), path.alias("file_path"), symbol.alias("symbol"))
    return evaluate.review_precision(f, starschema.symbols(spark, sf_dir), _files(spark, sf_dir))


DOCS = "dx AS (SELECT source AS scope, CASE doc_id % 5 WHEN 0 THEN 'readme' WHEN 1 THEN 'architecture' WHEN 2 THEN lang ELSE 'notes' END AS doc_type, lang FROM documents UNION ALL SELECT 'src1', 'runbook', 'en'), sc AS (SELECT DISTINCT source AS scope FROM documents UNION SELECT 'empty')\n"


@query("WITH " + DOCS + """, n AS (SELECT sc.scope, count(dx.scope) AS docs, count(DISTINCT CASE WHEN doc_type IN ('readme', 'architecture', 'runbook') THEN doc_type END) AS types FROM sc LEFT JOIN dx USING (scope) GROUP BY 1)
SELECT scope, 'docs_exist' AS name, 1::BIGINT AS total, (docs > 0)::BIGINT AS good, (docs > 0)::DOUBLE AS score, docs > 0 AS passed, CASE WHEN docs > 0 THEN 'pass' ELSE 'warning' END AS severity FROM n
UNION ALL SELECT scope, 'doc_types_present', 3, types, round(types / 3.0, 6), types = 3, CASE WHEN types = 3 THEN 'pass' ELSE 'warning' END FROM n WHERE docs > 0""", prelude=False)
def check_docs_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id") % 5
    kind = F.when(key == 0, "readme").when(key == 1, "architecture").when(key == 2, F.col("lang")).otherwise("notes")
    docs = d.select(F.col("source").alias("scope"), kind.alias("doc_type")).unionByName(spark.createDataFrame([("src1", "runbook")], "scope string, doc_type string"))
    scopes = d.select(F.col("source").alias("scope")).unionByName(spark.createDataFrame([("empty",)], "scope string"))
    return evaluate.docs_exist(scopes, docs)


@query("WITH n AS (SELECT namespace AS scope, count(*) AS n FROM sym GROUP BY 1) SELECT scope, 'symbol_coverage' AS name, 1::BIGINT AS total, (n > 0)::BIGINT AS good, (n > 0)::DOUBLE AS score, n > 0 AS passed, CASE WHEN n > 0 THEN 'pass' ELSE 'warning' END AS severity FROM n")
def check_symbol_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules as snapshots."""
    return evaluate.symbol_coverage(starschema.symbols(spark, sf_dir).select(F.col("namespace").alias("scope"), "fq_name"))


_PARTS = {
    "citation_coverage": "SELECT scope, len(cites) AS total, (SELECT count(*) FROM (SELECT unnest(cites) AS c) u WHERE c IN (SELECT DISTINCT file_path FROM sym)) AS good FROM ans",
    "factual_grounding": "SELECT * FROM grounded",
    "answer_completeness": COMPLETE,
}


@query("WITH " + ANSWER + GROUNDED + ", ck AS (" + " UNION ALL ".join(_judged(n, c) for n, c in _PARTS.items()) + """)
SELECT scope, round(avg(score), 6) AS score, CASE WHEN bool_or(severity = 'fail') THEN 'fail' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'pass' END AS severity, count(*) FILTER (passed) AS n_passed,
coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER (NOT passed)))[1:3], ','), '') AS failed FROM ck GROUP BY 1""")
def answer_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of every answer, composed and rolled up."""
    a, s, f = _answers(spark, sf_dir), starschema.symbols(spark, sf_dir), _files(spark, sf_dir)
    return guard.rollup(evaluate.composed([evaluate.citation_coverage(a, f), evaluate.factual_grounding(a, s, f), evaluate.answer_completeness(a)]))


# ---- reviews of diffs ----------------------------------------------------------------------------

#: Lines of made-up changes, of which every heuristic has some.
REMOVED = (
    "if (order.IsValid()) {", "throw new ArgumentNullException(x);", "guard.Against(x);", "if (y != null) return y;", "var z = y?.Name ?? w;", "try { Run(); }", "finally { Close(); }", "return total;", "while (open) {", "plain line", "var token = 1;", "invalidoperationexception e;",
)
ADDED = (
    "db.SaveChanges();", "items.Delete(x);", "bus.Publish(x);", "File.Delete(p);", "lock (gate) {", "await Task.Run(f);", "static int n = 0;", "static readonly string s = 1;", "var password = p;", "[Authorize]", "new SqlCommand(q);", "cookie.secure = true;", "RSA.Create();", "return total + 1;", "if (open) {",
    "other plain line", "return total;",
)


def _pick(items: tuple[str, ...], key: str) -> str:
    return "([" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + f"])[{key} % {len(items)} + 1]"


CHANGES = f"chg AS (SELECT p_partkey AS diff_id, path, st AS pl, {_pick(REMOVED, 'p_partkey')} AS old, {_pick(ADDED, 'p_partkey')} AS new FROM mem)\n"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One diff a part: its first line changed."""
    s = starschema.symbols(spark, sf_dir).filter("parent_fq_name is not null").select("file_path", "start_line", F.regexp_extract("fq_name", r"\.p(\d+)$", 1).try_cast("long").alias("diff_id"))
    pick = lambda items: F.element_at(F.array(*[F.lit(x) for x in items]), (F.col("diff_id") % len(items) + 1).cast("int"))
    at = F.concat(F.lit("@@ -"), F.col("start_line").cast("string"), F.lit(" +"), F.col("start_line").cast("string"), F.lit(" @@\n-"))
    return s.select("diff_id", F.concat(F.lit("diff --git a/"), "file_path", F.lit(" b/"), "file_path", F.lit("\n"), at, pick(REMOVED), F.lit("\n+"), pick(ADDED)).alias("diff"))


def _first(patterns: dict[str, str], column: str) -> str:
    cases = []
    for label, p in patterns.items():
        text = column
        if "(?!" in p:  # no lookahead there: what it excludes is taken out first
            text, p = f"regexp_replace({column}, '\\bstatic\\s(readonly\\s+string|readonly\\s+int)', '', 'g')", r"\bstatic\s+.*="
        cases.append(f"WHEN regexp_matches({text}, '{p}') THEN '{label}'")
    return f"CASE {' '.join(cases)} END"


def _heuristics() -> str:
    parts = []
    for category, (side, patterns, severity) in review.LINE_HEURISTICS.items():
        for s, column in (("removed", "old"), ("added", "new")):
            if side in (None, s):
                level = severity or ("high" if s == "removed" else "medium")
                parts.append(f"SELECT diff_id, path, pl AS line, '{category}' AS category, '{level}' AS severity, {_first(patterns, column)} AS label, {int(s == 'added')} AS pos FROM chg")
    for category, p, more in (("changed_condition", review.CONDITION, ""), ("changed_return", review.RETURN, " AND trim(old) <> trim(new)")):
        parts.append(f"SELECT diff_id, path, pl, '{category}', 'medium', CASE WHEN regexp_matches(old, '{p}') AND regexp_matches(new, '{p}'){more} THEN 'changed' END, 0 FROM chg")
    return "hits AS (" + " UNION ALL ".join(parts) + "),\nfd AS (SELECT diff_id, category, path, line::INT AS line, arg_min(severity, pos) AS severity, arg_min(label, pos) AS label FROM hits WHERE label IS NOT NULL GROUP BY 1, 2, 3, 4)\n"


@query("WITH " + CHANGES + ", " + _heuristics() + "SELECT * FROM fd")
def review_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all eight heuristics over one change a part."""
    return review.findings(review.diff_lines(_changes(spark, sf_dir)))


TOUCHED = "tch AS (SELECT diff_id, fq_name, 1 AS added, 1 AS removed FROM chg JOIN sym ON file_path = path AND pl BETWEEN start_line AND end_line)\n"


@query("WITH " + CHANGES + ", " + TOUCHED + "SELECT diff_id, fq_name, added::BIGINT AS added, removed::BIGINT AS removed, 'modified' AS change_type FROM tch")
def changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.changed_symbols(review.diff_lines(_changes(spark, sf_dir)), starschema.symbols(spark, sf_dir))


FAN_IN = "hfi AS (SELECT diff_id, fq_name, callers FROM tch JOIN (SELECT target AS fq_name, count(*) AS callers FROM edge WHERE edge_type = 'calls' GROUP BY 1) USING (fq_name) WHERE callers >= 5)\n"


@query("WITH " + CHANGES + ", " + TOUCHED + ", " + FAN_IN + "SELECT diff_id, 'high_fan_in_change' AS category, file_path AS path, start_line AS line, 'high' AS severity, fq_name AS label, callers FROM hfi JOIN sym USING (fq_name)")
def review_high_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = starschema.graph(spark, sf_dir)
    return review.high_fan_in(review.changed_symbols(review.diff_lines(_changes(spark, sf_dir)), g.symbols), g)


@query("WITH " + CHANGES + ", " + TOUCHED + ", " + FAN_IN + ", " + _heuristics() + """, cl3 AS (SELECT DISTINCT target AS b, source AS a FROM edge WHERE edge_type = 'calls'),
walk AS (SELECT DISTINCT diff_id, fq_name, 0 AS d FROM tch UNION SELECT diff_id, a, d + 1 FROM walk JOIN cl3 ON b = fq_name WHERE d < 3),
imp AS (SELECT diff_id, count(DISTINCT fq_name) AS impacted FROM walk w WHERE fq_name IN (SELECT fq_name FROM sym) AND NOT EXISTS (SELECT 1 FROM tch t WHERE t.diff_id = w.diff_id AND t.fq_name = w.fq_name) GROUP BY 1),
every AS (SELECT diff_id, severity FROM fd UNION ALL SELECT diff_id, 'high' FROM hfi),
c AS (SELECT diff_id, (SELECT count(*) FROM tch WHERE tch.diff_id = chg.diff_id)::INT AS changed, coalesce(impacted, 0)::INT AS impacted, coalesce(f, 0)::INT AS findings, coalesce(h, 0)::INT AS high FROM chg LEFT JOIN imp USING (diff_id)
  LEFT JOIN (SELECT diff_id, count(*) AS f, count(*) FILTER (severity IN ('critical', 'high')) AS h FROM every GROUP BY 1) USING (diff_id)),
s AS (SELECT *, least(least(changed * 4, 20) + least(impacted * 3, 30) + least(findings * 5, 30) + least(high * 10, 20), 100) AS risk_score FROM c)
SELECT diff_id, '1 file(s) changed, +1 additions, -1 deletions, ' || changed || ' symbol(s) affected.' AS summary, changed, impacted, findings, high, risk_score, CASE WHEN risk_score >= 70 THEN 'critical' WHEN risk_score >= 50 THEN 'high' WHEN risk_score >= 25 THEN 'medium' ELSE 'low' END AS risk_level FROM s""", recursive=True)
def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's change reviewed: summary, changed and impacted symbols, findings, risk."""
    return review.report(_changes(spark, sf_dir), starschema.graph(spark, sf_dir))


# ---- facts, context and answers ------------------------------------------------------------------


@query("WITH " + MODULE + """, keyc AS (SELECT namespace AS module, list_sort(list(fq_name)) AS k FROM sym WHERE kind IN ('class', 'interface') GROUP BY 1)
SELECT module, 'Module ''' || module || ''' contains ' || symbol_count || ' symbols across ' || file_count || ' files.' || CASE WHEN depends_on <> '' THEN ' Depends on: ' || array_to_string(string_split(depends_on, ',')[1:5], ', ') || '.' ELSE '' END AS purpose,
coalesce(array_to_string(k, ','), '') AS key_classes, 'Defines ' || coalesce(len(k), 0) || ' types' AS responsibility, 'high' AS confidence FROM mmet LEFT JOIN keyc USING (module)""")
def module_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = starschema.graph(spark, sf_dir)
    return facts.module_facts(metrics.module_metrics(g), g).withColumn("key_classes", F.array_join("key_classes", ","))


FILES = """ff AS (SELECT file_path AS path, string_agg(name, ', ' ORDER BY start_line, fq_name) FILTER (kind IN ('class', 'interface', 'struct')) AS types, count(*) AS symbols, min(namespace) AS space FROM sym GROUP BY 1),
fi AS (SELECT file_path AS path, count(DISTINCT target) AS imports FROM edge WHERE edge_type = 'imports' GROUP BY 1),
fx AS (SELECT path, CASE WHEN coalesce(space, '') <> '' THEN '[' || space || '] ' ELSE '' END || CASE WHEN types IS NOT NULL THEN 'Defines ' || types || '.' ELSE 'Utility file.' END AS purpose, coalesce(symbols, 0) AS symbols, coalesce(imports, 0) AS imports,
  CASE WHEN coalesce(symbols, 0) > 0 THEN 'high' ELSE 'low' END AS confidence FROM ff FULL JOIN fi USING (path))
"""


@query("WITH " + FILES + "SELECT * FROM fx")
def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.file_facts(starschema.graph(spark, sf_dir))


@query("WITH " + FILES + "SELECT path, 'File: ' || path || ' | ' || purpose || CASE WHEN imports > 0 THEN ' | Responsibilities: imports ' || imports ELSE '' END AS text FROM fx")
def summary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts.file_facts(starschema.graph(spark, sf_dir))
    none = F.array().cast("array<string>")
    does = F.when(F.col("imports") > 0, F.array(F.concat(F.lit("imports "), F.col("imports").cast("string")))).otherwise(none)
    return f.select("path", facts.summary_text(F.lit("File"), F.col("path"), F.col("purpose"), none, none, does).alias("text"))


#: One question a type symbol; every fifth names only the end of a name, every seventh nothing that is known.
ASKED = """ask AS (SELECT k AS id, (['flow', 'impact', 'architecture', 'component'])[k % 4 + 1] AS question_type, (['out', 'in', 'both', 'out'])[k % 4 + 1] AS dir, ([2, 3, 1, 2])[k % 4 + 1] AS hops, 'About ' || fq AS text, CASE WHEN k % 7 = 0 THEN 'no.such.name' WHEN k % 5 = 0 THEN '.S' || k || '.p' ELSE fq END AS target FROM styp),
hit AS (SELECT id, a.target, fq_name, name, kind, file_path, start_line, end_line, signature, row_number() OVER (PARTITION BY id ORDER BY fq_name) AS n FROM ask a JOIN sym s ON s.fq_name = a.target OR (NOT EXISTS (SELECT 1 FROM sym e WHERE e.fq_name = a.target) AND (contains(s.fq_name, a.target) OR s.name = a.target)))
"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = starschema.symbols(spark, sf_dir).filter("parent_fq_name is null").select(F.col("fq_name").alias("fq"), F.regexp_extract("name", r"^S(\d+)$", 1).try_cast("long").alias("id"))
    k = F.col("id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("flow", "impact", "architecture", "component")]), (k % 4 + 1).cast("int"))
    target = F.when(k % 7 == 0, "no.such.name").when(k % 5 == 0, F.concat(F.lit(".S"), k.cast("string"), F.lit(".p"))).otherwise(F.col("fq"))
    return t.select("id", kind.alias("question_type"), target.alias("target"), facts.direction_of(kind).alias("direction"), search.question_hops(kind).alias("max_hops"), F.concat(F.lit("About "), "fq").alias("text"))


@query("WITH " + ASKED + "SELECT id, target, fq_name, name, kind, file_path, start_line, end_line, signature FROM hit WHERE n <= 20")
def context_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.matched_symbols(_asked(spark, sf_dir), starschema.graph(spark, sf_dir))


def _hops(most: int) -> str:
    """SQL of the calls around each question's target, hop by hop: a node's first 30 edges, and a question's as `near`."""
    out = ["cal AS (SELECT source, target, file_path, 0 AS line FROM edge WHERE edge_type = 'calls')", "f1 AS (SELECT id, target AS node, dir, hops FROM ask)", "s1 AS (SELECT id, node FROM f1)"]
    for h in range(1, most + 1):
        out += [
            f"""e{h} AS (SELECT *, row_number() OVER (PARTITION BY id, node ORDER BY source, target, line, file_path) AS n FROM (SELECT DISTINCT f.id, f.node, c.* FROM f{h} f JOIN cal c
  ON (dir IN ('out', 'both') AND contains(c.source, node)) OR (dir IN ('in', 'both') AND contains(c.target, node)) WHERE hops >= {h}))""",
            f"k{h} AS (SELECT id, {h} AS hop, node, source, target, file_path, line FROM e{h} WHERE n <= 30)",
            f"f{h + 1} AS (SELECT r.id, r.node, dir, hops FROM (SELECT id, source AS node FROM k{h} UNION SELECT id, target FROM k{h} EXCEPT SELECT * FROM s{h}) r JOIN ask USING (id))",
            f"s{h + 1} AS (SELECT * FROM s{h} UNION SELECT id, node FROM f{h + 1})",
        ]
    every = " UNION ALL ".join(f"SELECT * FROM k{h}" for h in range(1, most + 1))
    return ",\n".join(out) + f",\nnear AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hop, node, source, target, line, file_path) AS m FROM ({every})) WHERE m <= 30)\n"


@query("WITH " + ASKED + ", " + _hops(3) + "SELECT id, hop, source, target, file_path, line FROM near")
def context_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many hops as the kind of question asks for: one to three."""
    return facts.call_context(_asked(spark, sf_dir), starschema.graph(spark, sf_dir))


def _unit(name: str, key: str, source: str) -> str:
    """SQL of the hash embedder's vectors."""
    value = "(('0x' || substr(sha256(unhex(sha256(text)) || unhex(printf('%08X', (i // 8)::INT))), ((i % 8) * 8 + 1)::INT, 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE) * 2 - 1"
    return f"{name} AS (SELECT {key} AS key, list_transform(range(0, 256), lambda i: {value}) AS v FROM {source})"


SUMMED = FILES + f""", mods AS (SELECT namespace AS module, count(*) AS n, count(DISTINCT file_path) AS files FROM sym WHERE namespace <> '' GROUP BY 1),
stx AS (SELECT path, 'File: ' || path || ' | ' || purpose || CASE WHEN imports > 0 THEN ' | Responsibilities: imports ' || imports ELSE '' END AS text FROM fx),
{_unit("qv", "id", "ask")}, {_unit("sv", "path", "stx")},
hits AS (SELECT q.key AS id, s.key AS path, row_number() OVER (PARTITION BY q.key ORDER BY round(list_cosine_similarity(q.v, s.v), 6) DESC, s.key) AS r FROM qv q, sv s),
ms AS (SELECT id, r, '  - [file] ' || text[1:200] AS line, path FROM hits JOIN stx USING (path) WHERE r <= 10
  UNION ALL SELECT id, 10 + row_number() OVER (PARTITION BY id ORDER BY module), '  - [module_summary] Module ''' || module || ''' contains ' || n || ' symbols across ' || files || ' files.', '' FROM ask, mods WHERE question_type = 'architecture'),
su AS (SELECT id, count(*) AS n, list(line ORDER BY r)[1:5] AS lines, list(path ORDER BY r)[1:5] AS paths FROM ms GROUP BY 1)
"""
ANSWERED = "WITH " + ASKED + ", " + _hops(3) + ", " + SUMMED + """, sy AS (SELECT id, list('**' || upper(kind[1]) || kind[2:] || ' `' || fq_name || '`**: declared in `' || file_path || '` (lines ' || start_line || '-' || end_line || '). Signature: `' || signature || '`.' ORDER BY fq_name) AS lines, list(fq_name ORDER BY fq_name) AS names FROM hit WHERE n <= 20 GROUP BY 1),
ed AS (SELECT id, list('  - `' || source || '` calls `' || target || '`' ORDER BY hop, source, target) AS lines, list_sort(list_distinct(list_concat(list(source), list(target)))) AS near FROM near GROUP BY 1),
x AS (SELECT a.id, a.question_type, coalesce(sy.lines, []) AS sl, coalesce(names, []) AS names, coalesce(ed.lines, []) AS el, coalesce(near, []) AS near, coalesce(su.lines, []) AS ml, coalesce(su.n, 0) AS mn FROM ask a LEFT JOIN sy USING (id) LEFT JOIN ed USING (id) LEFT JOIN su USING (id))
"""


def _summaries(spark: SparkSession, sf_dir: str, q: DataFrame) -> DataFrame:
    """Files as summaries, and modules for questions of architecture."""
    ref = lambda path: F.array(F.struct(path.alias("file_path"), F.lit("").alias("symbol"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line")))
    texts = summary_texts(spark, sf_dir).select(F.col("path").alias("key"), F.lit("file").alias("scope_type"), "text", ref(F.col("path")).alias("refs"))
    m = metrics.modules(starschema.graph(spark, sf_dir)).select(F.col("module").alias("name"), facts.said("module", "module", "symbol_count", "file_count").alias("text"), ref(F.lit("")).alias("refs"))
    return facts.related_summaries(q, texts, m)


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, g = _asked(spark, sf_dir), starschema.graph(spark, sf_dir)
    return facts.answers(q, facts.matched_symbols(q, g), facts.call_context(q, g), _summaries(spark, sf_dir, q))


@query(ANSWERED + """SELECT id, array_to_string(list_concat(sl, CASE WHEN len(el) > 0 THEN list_concat([chr(10) || '**Call relationships** (' || len(el) || ' edges):'], el[1:10]) ELSE [] END,
  CASE WHEN mn > 0 THEN list_concat([chr(10) || '**Related summaries** (' || mn || ' found):'], ml) ELSE [] END), chr(10)) AS answer_text, array_to_string(list_sort(list_distinct(list_concat(names, near[1:10])))[1:20], ',') AS related,
CASE WHEN 2 * (len(sl) > 0)::INT + 2 * (len(el) > 0)::INT + (mn > 0)::INT >= 4 THEN 'high' WHEN 2 * (len(sl) > 0)::INT + 2 * (len(el) > 0)::INT + (mn > 0)::INT >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM x""")
def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic answers from symbols, up to three hops of calls, the nearest summaries, and modules."""
    return _answered(spark, sf_dir).select("id", "answer_text", F.array_join("related", ",").alias("related"), "confidence")


@query(ANSWERED + """, shown AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hop, source, target) AS k FROM near)
SELECT id, file_path, fq_name AS symbol, start_line, end_line, 'Direct symbol match' AS relevance FROM hit WHERE n <= 20
UNION ALL SELECT id, file_path, '', line, 0, 'Call from ' || source || ' to ' || target FROM shown WHERE k <= 10
UNION ALL SELECT id, path, '', 0, 0, 'Vector search match' FROM (SELECT id, unnest(paths) AS path FROM su) WHERE path <> ''""")
def answer_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each answer rests on, a row a piece."""
    return _answered(spark, sf_dir).select("id", F.explode("evidence").alias("e")).select("id", "e.*")


def _checks_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    cases = " ".join(f"WHEN '{k}' THEN [" + ", ".join(f"[{quoted(w)}, {quoted(h)}]" for w, h in items) + "]" for k, items in facts.VERIFICATION.items())
    return f""", vl AS (SELECT id, list_concat(CASE question_type {cases} ELSE [] END,
  coalesce((SELECT list(['Review `' || fq_name || '` in `' || file_path || '`', 'Open ' || file_path || ' at line ' || start_line] ORDER BY fq_name) FROM hit h WHERE h.id = ask.id AND n <= 3), []))[1:7] AS c FROM ask)
SELECT id, place::INT AS place, v[1] AS description, v[2] AS how_to_verify FROM (SELECT id, unnest(generate_series(1, len(c))) AS place, unnest(c) AS v FROM vl)"""


@query("WITH " + ASKED + _checks_sql())
def answer_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to check of each answer, in order; edges and summaries do not matter to it."""
    q, g = _asked(spark, sf_dir), starschema.graph(spark, sf_dir)
    said = facts.answers(q, facts.matched_symbols(q, g), facts.call_context(q.limit(0), g))
    return said.select("id", F.posexplode("verification").alias("place", "v")).select("id", (F.col("place") + 1).alias("place"), "v.*")
