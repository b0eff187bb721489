"""Queries beside the graph: similarity, search, questions, snapshots, review, guards, usage, sinks and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..operators import guard, metrics, review, rules, search, similarity, snapshots, usage
from ..sources import files as file_source
from ..sources import manifests, starschema
from ..sources.starschema import table
from .graph_queries import AS_OF, LIMITS, NS, RULE_SQL, _findings_sql
from .registry import query


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


# ---- files and snapshots ------------------------------------------------------------------------


@query("SELECT lang AS language, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT sha256(text)) AS hashes FROM documents GROUP BY 1", prelude=False)
def files_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _documents(spark, sf_dir).select("lang", F.octet_length("text").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return f.groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"), F.count_distinct("hash").alias("hashes"))


@query("SELECT path, lower(regexp_extract(path, '([.][^./]+)$', 1)) AS extension, language FROM (SELECT DISTINCT file_path AS path FROM sym) p JOIN (SELECT '.py' AS e, 'python' AS language) l ON ends_with(path, e)")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = starschema.symbols(spark, sf_dir).select(F.col("file_path").alias("path")).distinct()
    return p.select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"), file_source.language_of(F.col("path")).alias("language"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files now, and before: without the largest source, and in lower case."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    d = _documents(spark, sf_dir)
    now = d.select(path.alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return now, d.filter("source <> 'src0'").select(path.alias("path"), F.sha2(F.lower("text").cast("binary"), 256).alias("hash"))


@query("""SELECT path, hash, CASE WHEN old IS NULL THEN 'new' ELSE 'modified' END AS change FROM (SELECT source || '/' || doc_id AS path, sha256(text) AS hash, CASE WHEN source <> 'src0' THEN sha256(lower(text)) END AS old FROM documents) WHERE old IS NULL OR old <> hash""", prelude=False)
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changed_files(*_snapshots(spark, sf_dir))


@query("SELECT fq_name, file_path FROM sym WHERE file_path NOT IN (SELECT file_path FROM edge WHERE edge_type = 'calls')")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of files that no call comes from, which stand for the unchanged ones."""
    g = starschema.graph(spark, sf_dir)
    s = g.symbols.select("fq_name", "file_path")
    changed = g.of_type("calls").select(F.col("file_path").alias("path")).distinct()
    return snapshots.carry_forward(s, s.select(F.col("file_path").alias("path")).distinct(), changed)


SIDES = """base AS (SELECT l_partkey AS p, max(l_quantity) AS q, min(l_shipdate) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
head AS (SELECT l_partkey AS p, max(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1),
chg AS (SELECT 'p' || coalesce(b.p, h.p) AS fq_name, 'part' AS kind, CASE WHEN b.p IS NULL THEN 'added' WHEN h.p IS NULL THEN 'removed' WHEN b.q = h.q THEN 'unchanged' ELSE 'modified' END AS change FROM base b FULL JOIN head h ON b.p = h.p)
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("early"))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(o, "l_orderkey")
    side = lambda early: x.filter(F.col("early") == early).groupBy("l_partkey").agg(F.max("l_quantity").alias("q")).select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("fq_name"), F.lit("part").alias("kind"), "q")
    return side(True), side(False)


@query("WITH " + SIDES + "SELECT * FROM chg", prelude=False)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.diff(*_sides(spark, sf_dir), compared=("q",))


@query("WITH " + SIDES + "SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'unchanged') AS unchanged FROM chg", prelude=False)
def snapshot_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.diff_summary(snapshots.diff(*_sides(spark, sf_dir), compared=("q",)))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1", prelude=False)
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


# ---- similarity ---------------------------------------------------------------------------------

UNITS = """units AS (SELECT doc_id AS unit, md5(lower(text)) AS fingerprint, list_sort(list_distinct(list_transform(range(1, greatest(len(l) - 4, 1) + 1), lambda i: substr(md5(array_to_string(l[i:i + 4], chr(10))), 1, 16)))) AS windows
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)),
cls AS (SELECT windows, min(unit) AS u FROM units GROUP BY 1)
"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("unit"), F.md5(F.lower("text").cast("binary")).alias("fingerprint"), similarity.line_windows(F.col("text")).alias("windows"))


@query("WITH " + UNITS + "SELECT fingerprint, count(*) AS members, min(unit) AS first FROM units GROUP BY 1 HAVING count(*) >= 2", prelude=False)
def exact_clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.exact_groups(_units(spark, sf_dir).drop("windows"))


@query("WITH " + UNITS + """SELECT a.u AS a, b.u AS b, round(len(list_intersect(a.windows, b.windows))::DOUBLE / (len(a.windows) + len(b.windows) - len(list_intersect(a.windows, b.windows))), 6) AS similarity FROM cls a JOIN cls b ON a.u < b.u AND list_has_any(a.windows, b.windows)
WHERE len(list_intersect(a.windows, b.windows))::DOUBLE / (len(a.windows) + len(b.windows) - len(list_intersect(a.windows, b.windows))) >= 0.6""", prelude=False)
def near_clone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_pairs(_units(spark, sf_dir).select("unit", "windows"))


SENTENCES = UNITS.replace("string_split(text, chr(10))", "regexp_split_to_array(text, '[.][ \n]+')")


@query("WITH " + SENTENCES + """SELECT a, b, round(shared::DOUBLE / (na + nb - shared), 6) AS similarity FROM (SELECT a.u AS a, b.u AS b, len(a.windows) AS na, len(b.windows) AS nb, len(list_intersect(a.windows, b.windows)) AS shared
FROM cls a JOIN cls b ON a.u < b.u AND list_has_any(a.windows, b.windows)) WHERE shared::DOUBLE / (na + nb - shared) >= 0.6""", prelude=False)
def near_clone_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near clones with sentences as statements: of invented prose, copies with few changes."""
    d = _documents(spark, sf_dir)
    return similarity.near_pairs(d.select(F.col("doc_id").alias("unit"), similarity.windows_of(F.split("text", r"[.][ \n]+")).alias("windows")))


@query("WITH " + UNITS + "SELECT unit, u AS class FROM units JOIN cls USING (windows)", prelude=False)
def near_clone_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.classes(_units(spark, sf_dir).select("unit", "windows")).select("unit", "class")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""", prelude=False)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similarity.nearest(e, e.orderBy("id").limit(1))


VECTORS = """raw AS (SELECT conv_id, turn, list_transform(range(0, 256), lambda i: (('0x' || substr(sha256(unhex(sha256(text)) || unhex(printf('%08X', (i // 8)::INT))), ((i % 8) * 8 + 1)::INT, 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE) * 2 - 1) AS v FROM conversations),
unit AS (SELECT conv_id, turn, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS vector FROM raw)
"""


@query("WITH " + VECTORS + "SELECT * FROM unit", prelude=False)
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.transform(similarity.hash_embedding(F.col("text")), lambda v: F.round(v, 6)).alias("vector"))


@query("""SELECT id, other, score, rank::INT AS rank FROM (SELECT q.vec_id AS id, v.vec_id AS other, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= 10""", prelude=False)
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole set of query vectors, those with ids divisible by 20, against all."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similarity.nearest_many(e, e.filter("id % 20 = 0"), 10)


# ---- search and questions -----------------------------------------------------------------------

SCORE = "greatest(CASE WHEN lower(name) = 'ring' THEN 10.0 WHEN contains(lower(name), 'ring') THEN 5.0 ELSE 0.0 END + CASE WHEN contains(lower(fq_name), 'ring') THEN 3.0 ELSE 0.0 END + CASE WHEN contains(lower(namespace), 'ring') THEN 1.0 ELSE 0.0 END, 0.1)::DOUBLE"
SYM_HITS = f"SELECT fq_name AS id, name AS title, {SCORE} AS score FROM sym WHERE name ILIKE '%ring%' OR fq_name ILIKE '%ring%' OR namespace ILIKE '%ring%' OR signature ILIKE '%ring%'"


@query(SYM_HITS)
def search_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_symbols(starschema.symbols(spark, sf_dir), "ring")


@query(f"""SELECT entity, id, title, score FROM (SELECT 'symbol' AS entity, 0 AS o, * FROM ({SYM_HITS}) UNION ALL SELECT 'document', 1, doc_id::VARCHAR, source, CASE WHEN lower(source) = 'ring' THEN 10.0 WHEN contains(lower(source), 'ring') THEN 5.0 ELSE 0.1 END::DOUBLE
FROM documents WHERE source ILIKE '%ring%' OR text ILIKE '%ring%') ORDER BY score DESC, o, id LIMIT 20 OFFSET 10""")
def search_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("body"))
    return search.search_all({"symbol": search.search_symbols(starschema.symbols(spark, sf_dir), "ring"), "document": search.search_texts(d, "ring")}, 20, 10)


@query(r"""WITH tok AS (SELECT fq_name, string_split_regex(lower(concat_ws(' ', regexp_replace(fq_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), regexp_replace(signature, '([a-z0-9])([A-Z])', '\1 \2', 'g'))), '[^\p{L}\p{N}]+') AS t FROM sym)
SELECT fq_name, (len(list_filter(t, lambda x: x = 'red')) + len(list_filter(t, lambda x: x = 'widget')))::BIGINT AS rank FROM tok WHERE list_contains(t, 'red') AND list_contains(t, 'widget')""")
def fulltext_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.full_text(starschema.symbols(spark, sf_dir), "Red widget")


def _points(kind: str) -> str:
    return " + ".join(f"regexp_matches(low, '{p}')::INT" for p in search.QUESTION_PATTERNS[kind])


KINDS = list(search.QUESTION_PATTERNS)
QTYPE = f"""q AS (SELECT conv_id, turn, text, {", ".join(f"({_points(k)}) AS {k}" for k in KINDS)} FROM (SELECT *, lower(text) AS low FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT p_partkey, -1, 'What does the ' || p_name || ' class do when it breaks the ' || p_type || ' flow of `' || p_brand || '.' || p_name || '` or ModuleFlow.Base.Part and UserService?' FROM part))),
t AS (SELECT conv_id, turn, text, CASE {" ".join(f"WHEN {k} > 0 AND {k} = greatest({', '.join(KINDS)}) THEN '{k}'" for k in KINDS)} ELSE 'general' END AS question_type FROM q)
"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    p = table(spark, sf_dir, "part")
    said = F.concat(F.lit("What does the "), "p_name", F.lit(" class do when it breaks the "), "p_type", F.lit(" flow of `"), "p_brand", F.lit("."), "p_name", F.lit("` or ModuleFlow.Base.Part and UserService?"))
    return search.questions(c.unionByName(p.select(F.col("p_partkey").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), said.alias("text"))))


@query("WITH " + QTYPE + "SELECT conv_id, turn, question_type, CASE question_type WHEN 'impact' THEN 3 WHEN 'architecture' THEN 1 ELSE 2 END AS max_hops FROM t", prelude=False)
def classify_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", "question_type", "max_hops")


@query("WITH " + QTYPE + r"""SELECT conv_id, turn, CASE WHEN len(b) > 0 THEN b[1] WHEN len(d) > 0 THEN list_reduce(list_prepend('', d), lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END) WHEN len(p) > 0 THEN p[1] ELSE '' END AS target_symbol
FROM (SELECT conv_id, turn, regexp_extract_all(text, '`([A-Za-z_][\w.]*)`', 1) AS b, regexp_extract_all(text, '\b([A-Z][a-zA-Z0-9]*(?:\.[A-Z][a-zA-Z0-9]*)+)\b', 1) AS d, regexp_extract_all(text, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b', 1) AS p FROM t)""", prelude=False)
def extract_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", "target_symbol")


@query(r"""WITH co AS (SELECT source AS fq_name, count(*) AS callees, sum(regexp_matches(lower(target), 'write|save|delete|remove|send|post|update|insert')::INT + regexp_matches(lower(target), 'log|print|trace|console')::INT) AS effects FROM edge WHERE edge_type = 'calls' GROUP BY 1),
ci AS (SELECT target AS fq_name, count(*) AS callers FROM edge WHERE edge_type = 'calls' GROUP BY 1), ch AS (SELECT source AS fq_name, count(*) AS children FROM edge WHERE edge_type = 'contains' GROUP BY 1),
x AS (SELECT s.*, coalesce(callees, 0) AS callees, coalesce(effects, 0) AS effects, coalesce(callers, 0) AS callers, coalesce(children, 0) AS children FROM sym s LEFT JOIN co USING (fq_name) LEFT JOIN ci USING (fq_name) LEFT JOIN ch USING (fq_name))
SELECT fq_name, CASE kind WHEN 'class' THEN 'Class ''' || name || ''' with ' || children || ' members.' WHEN 'interface' THEN 'Interface ''' || name || ''' defining a contract.'
WHEN 'method' THEN concat_ws(', ', 'Method ''' || name || '''', CASE WHEN return_type <> '' THEN 'returns ' || return_type END, CASE WHEN n_params > 0 THEN 'takes ' || n_params || ' parameter(s)' END, CASE WHEN callees > 0 THEN 'calls ' || callees || ' other symbol(s)' END, CASE WHEN callers > 0 THEN 'called by ' || callers || ' symbol(s)' END) || '.'
WHEN 'constructor' THEN 'Constructor for ''' || parent || '''.' WHEN 'property' THEN 'Property ''' || name || ''' of type ' || return_type || '.' ELSE upper(kind[1]) || kind[2:] || ' ''' || name || '''.' END AS purpose,
CASE WHEN kind IN ('method', 'constructor') THEN effects ELSE 0 END::BIGINT AS n_effects, CASE WHEN kind = 'method' THEN (n_params = 0)::INT + (contains(mods, 'static') AND n_params > 0)::INT ELSE 0 END AS n_assumptions,
(callers >= 5)::INT + (callees >= 5)::INT + (end_line - start_line + 1 >= 50)::INT AS n_risks,
CASE WHEN (signature <> '')::INT + (n_params > 0 OR return_type <> '')::INT + (doc_comment <> '')::INT + (callees + callers > 0)::INT >= 3 THEN 'high' WHEN (signature <> '')::INT + (n_params > 0 OR return_type <> '')::INT + (doc_comment <> '')::INT + (callees + callers > 0)::INT >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM x""")
def symbol_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.symbol_facts(starschema.graph(spark, sf_dir))


# ---- review -------------------------------------------------------------------------------------


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a new file of a diff."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\nnew file mode 100644\n@@ -0,0 +1 @@\n+"))
    return _documents(spark, sf_dir).select(F.col("doc_id").alias("diff_id"), F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n+"))).alias("diff"))


@query("SELECT doc_id AS diff_id, count(*) AS added, max(i)::INT AS last_number, true AS is_new FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) GROUP BY 1", prelude=False)
def diff_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.diff_lines(_diffs(spark, sf_dir)).groupBy("diff_id").agg(F.count_if(F.col("side") == "added").alias("added"), F.max("number").alias("last_number"), F.bool_and("is_new").alias("is_new"))


@query(r"""SELECT doc_id AS diff_id, i::INT AS line, 'medium' AS severity, 'secret' AS label FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
WHERE regexp_matches(t, '(?i)\b(password|secret|token|apikey|api_key|credential)\b')""", prelude=False)
def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security findings of secrets over all documents as diffs."""
    return review.findings(review.diff_lines(_diffs(spark, sf_dir))).filter("category = 'security_sensitive' and label = 'secret'").select("diff_id", "line", "severity", "label")


@query("""WITH c AS (SELECT o_custkey AS id, count(*)::INT AS changed, count(*) FILTER (o_orderstatus = 'F')::INT AS impacted, count(*) FILTER (o_orderstatus = 'O')::INT AS findings, count(*) FILTER (o_orderpriority = '1-URGENT')::INT AS high FROM orders GROUP BY 1),
s AS (SELECT *, least(least(changed * 4, 20) + least(impacted * 3, 30) + least(findings * 5, 30) + least(high * 10, 20), 100) AS risk_score FROM c)
SELECT *, CASE WHEN risk_score >= 70 THEN 'critical' WHEN risk_score >= 50 THEN 'high' WHEN risk_score >= 25 THEN 'medium' ELSE 'low' END AS risk_level FROM s""", prelude=False)
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, n = F.col("o_orderstatus"), lambda c: F.count_if(c).cast("int")
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("int").alias("changed"), n(status == "F").alias("impacted"), n(status == "O").alias("findings"), n(F.col("o_orderpriority") == "1-URGENT").alias("high"))
    return review.risk(c)


# ---- guards -------------------------------------------------------------------------------------


def _redact_sql(column: str) -> str:
    for kind, p in guard.PII.items():
        column = f"regexp_replace({column}, '{p}', '[{kind}_REDACTED]', 'g')"
    return column


@query(f"SELECT doc_id AS id, sha256({_redact_sql('text')}) AS text_sha256, {_redact_sql('text')} = text AS passed, CASE WHEN {_redact_sql('text')} = text THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM documents", prelude=False)
def sanitize_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.output_check(_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))


_INJ = ", ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in guard.INJECTION.items())


@query(f"SELECT conv_id, turn, concat_ws(',', {_INJ}) AS found FROM (SELECT conv_id, turn, role || ': ' || text AS text FROM conversations)", prelude=False)
def prompt_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("role", F.lit(": "), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(guard.injections(said), ",").alias("found"))


REFS = "claim AS (SELECT p_partkey AS id, 'S' || (p_partkey % 150) AS x, 'p' || replace(p_name, ' ', '_') AS y FROM part)\n"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    tick = F.lit("`")
    said = F.concat(tick, F.lit("S"), (F.col("p_partkey") % 150).cast("string"), F.lit("` calls `p"), F.replace("p_name", F.lit(" "), F.lit("_")), tick)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), said.alias("text"))


@query("WITH " + REFS + """, r AS (SELECT DISTINCT id, unnest([x, y]) AS ref FROM claim), r2 AS (SELECT * FROM r WHERE length(ref) > 2),
bad AS (SELECT ref FROM (SELECT DISTINCT ref FROM r2) d WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE contains(s.name, ref) OR contains(ref, s.name))),
g AS (SELECT c.id, count(r2.ref) AS refs, count(bad.ref) AS unknown FROM claim c LEFT JOIN r2 USING (id) LEFT JOIN bad USING (ref) GROUP BY 1)
SELECT id, refs, unknown, round(1 - CASE WHEN refs > 0 THEN unknown::DOUBLE / refs ELSE 0 END, 6) AS score, CASE WHEN unknown = 0 THEN 'pass' WHEN unknown::DOUBLE / refs > 0.3 THEN 'fail' ELSE 'warning' END AS severity FROM g""")
def hallucinated_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.unknown_references(_claims(spark, sf_dir), starschema.symbols(spark, sf_dir).select("name"))


@query("WITH " + REFS + "SELECT id, 1::BIGINT AS claims, (NOT EXISTS (SELECT 1 FROM edge WHERE source = x AND target = y))::BIGINT AS unknown FROM claim")
def hallucinated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.unknown_claims(_claims(spark, sf_dir), starschema.edges(spark, sf_dir))


_CHECKS = " UNION ALL ".join(
    f"SELECT m, '{n}' AS name, round(CASE WHEN total > 0 THEN good::DOUBLE / total ELSE {none} END, 6) AS score, total = 0 OR good::DOUBLE / total >= {least} AS passed FROM mo" for n, (least, none) in guard.RATIO_CHECKS.items()
)
CHECKS = f"mo AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS good FROM orders GROUP BY 1), ck AS ({_CHECKS})\n"


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ratio checks of each month: the share of finished orders."""
    o = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("m")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("good"))
    each = [F.struct(F.lit(n).alias("name"), guard.ratio_check(F.col("good"), F.col("total"), least, none).alias("c")) for n, (least, none) in guard.RATIO_CHECKS.items()]
    return o.select("m", F.explode(F.array(*each)).alias("x")).select("m", "x.name", "x.c.score", "x.c.passed")


@query("WITH " + CHECKS + "SELECT * FROM ck", prelude=False)
def ratio_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir)


@query("SELECT o_custkey AS review, count(*) AS findings, count(DISTINCT o_orderpriority) AS severities, NOT (count(*) >= 3 AND count(DISTINCT o_orderpriority) = 1) AS passed FROM orders GROUP BY 1", prelude=False)
def severity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.severity_distribution(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("review"), F.col("o_orderpriority").alias("severity")))


@query("WITH " + CHECKS + """SELECT m AS scope, round(avg(score), 6) AS score, CASE WHEN bool_or(NOT passed AND score < 0.3) THEN 'fail' WHEN bool_or(NOT passed) THEN 'warning' ELSE 'pass' END AS severity, count(*) FILTER (passed) AS n_passed,
coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER (NOT passed)))[1:3], ','), '') AS failed FROM ck GROUP BY 1""", prelude=False)
def evaluation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _checks(spark, sf_dir).withColumnRenamed("m", "scope")
    return guard.rollup(c.withColumn("severity", F.when(F.col("passed"), "pass").when(F.col("score") < 0.3, "fail").otherwise("warning")))


@query("WITH " + CHECKS + """, e AS (SELECT name AS scope, m, score FROM ck), g AS (SELECT scope, count(*) AS points, round(arg_min(score, m), 6) AS first, round(arg_max(score, m), 6) AS last, round(arg_max(score, m) - arg_min(score, m), 4) AS change FROM e GROUP BY 1)
SELECT *, CASE WHEN change > 0.02 THEN 'improving' WHEN change < -0.02 THEN 'declining' ELSE 'stable' END AS direction FROM g""", prelude=False)
def health_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.trend(_checks(spark, sf_dir).select(F.col("name").alias("scope"), F.col("m").alias("at"), "score"))


# ---- usage --------------------------------------------------------------------------------------


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("action"), F.floor("value").cast("long").alias("tokens"), F.col("ts").alias("at"))


@query("SELECT user_id, ts::DATE AS period, sum(floor(value)::BIGINT)::BIGINT AS tokens, count(*) AS actions FROM events GROUP BY 1, 2", prelude=False)
def quota_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.quota(_usage(spark, sf_dir), "day")


@query("SELECT user_id, date_trunc('month', ts)::DATE AS period, sum(floor(value)::BIGINT)::BIGINT AS tokens, count(*) AS actions, sum(floor(value)::BIGINT) >= 1000 AS exceeded FROM events GROUP BY 1, 2", prelude=False)
def quota_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _usage(spark, sf_dir)
    limits = u.select("user_id").distinct().withColumn("token_limit", F.lit(1000))
    return usage.over_quota(usage.quota(u, "month"), limits).drop("token_limit")


LAT = "d AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000), l AS (SELECT event_type AS route, count(*) AS n, round(sum(value), 4) AS total, list_sort(list(value))[floor(count(*) * 0.5)::INT + 1] AS p50, list_sort(list(value))[floor(count(*) * 0.99)::INT + 1] AS p99 FROM d GROUP BY 1)\n"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("value").alias("duration"))


@query("WITH " + LAT + "SELECT * FROM l", prelude=False)
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.latencies(_samples(spark, sf_dir))


_AT = lambda q: f"list_sort(list(value))[least(floor(count(*) * {q})::INT + 1, count(*)::INT)]"


@query(" UNION ALL ".join(f"SELECT route, {q}::DOUBLE AS q, count(*) AS n, {_AT(q)} AS duration FROM (SELECT event_type AS route, value FROM events UNION ALL SELECT '*', value FROM events) WHERE value IS NOT NULL GROUP BY 1" for q in (0.0, 0.5, 0.99, 1.0)), prelude=False)
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, median, 99th percentile and greatest of each route, and of all events as one group."""
    s = _samples(spark, sf_dir).select("route", "duration")
    return usage.exact_quantiles(s.unionByName(s.withColumn("route", F.lit("*"))), [0.0, 0.5, 0.99, 1.0])


MASKED = "CASE WHEN len(s) >= 12 AND regexp_full_match(lower(s), '[0-9a-f-]+') THEN '{id}' ELSE s END"


@query(f"""SELECT path, count(*) AS requests FROM (SELECT '/' || array_to_string(list_transform(string_split(trim('/repos/' || p || '/snapshots/' || substr(p, 1, 12) || '/files/' || k, '/'), '/'), lambda s: {MASKED}), '/') AS path
FROM (SELECT md5(event_id::VARCHAR) AS p, event_type || CASE WHEN event_id % 3 = 0 THEN '/' ELSE '' END AS k FROM events)) GROUP BY 1""", prelude=False)
def request_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by path with ids masked; an event stands for a request of a repository's snapshot."""
    digest = F.md5(F.col("event_id").cast("string").cast("binary"))
    path = F.concat(F.lit("/repos/"), digest, F.lit("/snapshots/"), F.substring(digest, 1, 12), F.lit("/files/"), "event_type", F.when(F.col("event_id") % 3 == 0, "/").otherwise(""))
    return table(spark, sf_dir, "events").select(usage.masked_path(path).alias("path")).groupBy("path").agg(F.count("*").alias("requests"))


@query("""WITH RECURSIVE ev AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
b AS (SELECT key, n, id, s, 5.0::DOUBLE AS t FROM ev WHERE n = 1
  UNION ALL SELECT e.key, e.n, e.id, e.s, least(5.0, b.t - (b.t >= 1)::INT + greatest(0.0, e.s - b.s) * 0.0005)::DOUBLE FROM b JOIN ev e ON e.key = b.key AND e.n = b.n + 1)
SELECT key, id, t >= 1 AS allowed FROM b""", prelude=False)
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return usage.token_bucket(r, rate=0.0005, burst=5)


# ---- sinks and sources --------------------------------------------------------------------------

def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(starschema.graph(spark, sf_dir, blame=True), LIMITS, as_of=AS_OF)


_EVERY = _findings_sql(list(RULE_SQL))


@query(_EVERY + "SELECT rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'error' THEN 'error' WHEN 'info' THEN 'note' ELSE 'warning' END AS level, rule_name || ': ' || symbol_fq_name AS text, file_path AS uri, greatest(line, 1)::INT AS start_line FROM found", recursive=True)
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sarif_results(_found(spark, sf_dir))


@query(_EVERY + "SELECT '| ' || severity || ' | ' || count(*) || ' |' AS line FROM found GROUP BY severity", recursive=True)
def markdown_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.severity_table(rules.findings(starschema.graph(spark, sf_dir, blame=True), LIMITS, as_of=AS_OF, per=("severity",)))


@query("WITH " + NS + """, n AS (SELECT namespace, count(*) AS n FROM sym GROUP BY 1 ORDER BY 1 LIMIT 80) SELECT 1 AS part, '    ' || regexp_replace(namespace, '[.\\- ]', '_', 'g') || '["' || namespace || '<br/>' || n || ' symbols"]' AS line FROM n
UNION ALL SELECT 2, '    ' || regexp_replace(a, '[.\\- ]', '_', 'g') || ' --> ' || regexp_replace(b, '[.\\- ]', '_', 'g') FROM nsdep WHERE a IN (SELECT namespace FROM n) AND b IN (SELECT namespace FROM n)""")
def mermaid_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = starschema.graph(spark, sf_dir)
    return sinks.mermaid_modules(g, metrics.namespace_dependencies(g))


@query("WITH " + LAT + """, c AS (SELECT event_type AS route, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, count(*) AS n FROM events GROUP BY 1, 2)
SELECT 'weftgraph_requests_total{route="' || route || '",status="' || status || '"} ' || n AS line FROM c UNION ALL SELECT 'weftgraph_request_duration_seconds{route="' || route || '",quantile="0.5"} ' || printf('%.6f', p50) FROM l
UNION ALL SELECT 'weftgraph_request_duration_seconds{route="' || route || '",quantile="0.99"} ' || printf('%.6f', p99) FROM l UNION ALL SELECT 'weftgraph_request_duration_seconds_count{route="' || route || '"} ' || n FROM l
UNION ALL SELECT 'weftgraph_request_duration_seconds_sum{route="' || route || '"} ' || printf('%.6f', total) FROM l""", prelude=False)
def prometheus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    counts = s.groupBy("route", F.when(F.col("route") == "error", "500").otherwise("200").alias("status")).agg(F.count("*").alias("n"))
    return sinks.prometheus_lines(counts, usage.latencies(s))


@query("""SELECT name, CASE WHEN regexp_replace(version, '^[=!<>~]+', '') = '' THEN '*' ELSE regexp_replace(version, '^[=!<>~]+', '') END AS version, 'pypi' AS ecosystem, file_path || '/requirements.txt' AS file_path, false AS is_dev, starts_with(version, '==') AND NOT contains(version, ',') AS is_pinned
FROM (SELECT replace(name, '#', '_') AS name, version, file_path FROM dep)""")
def requirements_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements files written from the declared dependencies, and read again."""
    d = starschema.dependencies(spark, sf_dir).select("file_path", F.concat(F.replace("name", F.lit("#"), F.lit("_")), F.lit(" "), "version").alias("line"))
    files = d.groupBy(F.concat("file_path", F.lit("/requirements.txt")).alias("file_path")).agg(F.array_join(F.collect_list("line"), "\n").alias("content"))
    return manifests.dependencies(files)
