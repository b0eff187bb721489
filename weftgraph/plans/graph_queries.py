"""Queries over the code graph: metrics, traversals and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, paging, rules, traverse
from ..operators.blame import by_symbol
from ..sources import starschema
from .registry import QUERIES, query

#: SQL of a symbol's module, of functions, and of fan-in and fan-out.
FUNCS = "kind IN ('method', 'constructor')"
FAN = """
cll AS (SELECT DISTINCT source, target FROM edge WHERE edge_type = 'calls'),
fin AS (SELECT target AS fq_name, count(*) AS fan_in FROM cll GROUP BY 1),
fout AS (SELECT source AS fq_name, count(*) AS fan_out FROM cll GROUP BY 1),
sfan AS (SELECT s.*, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, end_line - start_line + 1 AS loc FROM sym s LEFT JOIN fin USING (fq_name) LEFT JOIN fout USING (fq_name))
"""


@query("SELECT fq_name, kind, namespace, start_line FROM sym WHERE kind = 'method' AND namespace = (SELECT min(namespace) FROM sym)")
def list_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = starschema.symbols(spark, sf_dir)
    first = F.broadcast(s.agg(F.min("namespace").alias("namespace")))  # one row
    return s.filter("kind = 'method'").join(first, "namespace").select("fq_name", "kind", "namespace", "start_line")


@query("SELECT source, target, edge_type FROM edge WHERE edge_type IN ('calls', 'imports')")
def list_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starschema.graph(spark, sf_dir).of_type("calls", "imports").select("source", "target", "edge_type")


@query("SELECT fq_name, count(*) OVER () AS total, true AS has_more FROM sym ORDER BY namespace, fq_name LIMIT 50 OFFSET 100")
def pagination_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 50 from row 100, with the total and whether more follow."""
    s = starschema.symbols(spark, sf_dir).select("namespace", "fq_name")
    total = F.broadcast(s.agg(F.count("*").alias("total")))  # one row
    return s.orderBy("namespace", "fq_name").offset(100).limit(50).select("fq_name").crossJoin(total).withColumn("has_more", F.lit(150) < F.col("total"))


@query("SELECT source, target, edge_type, file_path, count(*) OVER () AS total, true AS has_more FROM edge ORDER BY edge_type, source, target, file_path LIMIT 50 OFFSET 1500")
def late_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far from the start, read from the ranges of a rank index that hold it."""
    e = starschema.edges(spark, sf_dir).select("source", "target", "edge_type", "file_path")
    return paging.rank_index(e, ["edge_type", "source", "target", "file_path"], 16).page(50, 1500)


@query("""SELECT 'kind:' || kind AS item, count(*) AS n FROM sym GROUP BY 1 UNION ALL SELECT 'symbols', count(*) FROM sym
UNION ALL SELECT 'modules', count(DISTINCT namespace) FROM sym UNION ALL SELECT 'edges', count(*) FROM edge""")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overview(starschema.graph(spark, sf_dir))


@query("WITH " + FAN + "SELECT fq_name, fan_in, fan_out FROM sfan")
def fan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_fan(starschema.graph(spark, sf_dir)).select("fq_name", "fan_in", "fan_out")


METRICS_SQL = (
    "WITH "
    + FAN
    + """, kids AS (SELECT source AS fq_name, count(*) AS child_count FROM edge WHERE edge_type = 'contains' GROUP BY 1), smet AS (
SELECT fq_name, kind, namespace, file_path, loc AS lines, fan_in, fan_out, coalesce(child_count, 0) AS child_count, contains(mods, 'public') AS is_public, contains(mods, 'static') AS is_static FROM sfan LEFT JOIN kids USING (fq_name))
"""
)


@query(METRICS_SQL + "SELECT * FROM smet")
def symbol_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.symbol_metrics(starschema.graph(spark, sf_dir))


@query(METRICS_SQL + "SELECT * FROM smet WHERE fan_in >= 2 AND lines >= 20")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hotspots(starschema.graph(spark, sf_dir), 2, 20)


@query("""WITH i AS (SELECT target AS fq_name, count(*) AS edges_in FROM edge WHERE edge_type = 'calls' GROUP BY 1), o AS (SELECT source AS fq_name, count(*) AS edges_out FROM edge WHERE edge_type = 'calls' GROUP BY 1)
SELECT fq_name, end_line - start_line AS span, coalesce(edges_in, 0) AS edges_in, coalesce(edges_out, 0) AS edges_out FROM sym LEFT JOIN i USING (fq_name) LEFT JOIN o USING (fq_name)
WHERE coalesce(edges_in, 0) >= 3 OR coalesce(edges_out, 0) >= 3 OR end_line - start_line >= 30 ORDER BY coalesce(edges_in, 0) DESC, fq_name LIMIT 20""")
def notable_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.notable(starschema.graph(spark, sf_dir))


@query(f"""SELECT count(*) AS functions, round(avg(cc), 6) AS avg_cyclomatic, round(avg(cog), 6) AS avg_cognitive, max(cc) AS max_cyclomatic, arg_min(fq_name, (-cc, fq_name)) AS most_complex,
count(*) FILTER (cc > 15) AS high_cyclomatic, count(*) FILTER (cog > 20) AS high_cognitive FROM sym WHERE {FUNCS} AND cc >= 5""")
def complexity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.complexity_report(starschema.graph(spark, sf_dir), 5)


BLAMED = """bl AS (SELECT s.fq_name, count(DISTINCT author) AS author_count, count(DISTINCT commit) AS commit_count, arg_max(author, (committed_at, -line_no)) AS last_author, max(committed_at) AS last_modified_at
FROM sym s JOIN blame b ON s.file_path = b.file_path AND line_no BETWEEN start_line AND end_line GROUP BY 1)
"""


@query("WITH " + BLAMED + "SELECT * FROM bl")
def blame_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_symbol(starschema.symbols(spark, sf_dir), starschema.blame_lines(spark, sf_dir))


@query("WITH " + BLAMED + f"SELECT last_author AS author, count(*) AS functions, count(DISTINCT file_path) AS files, string_agg(DISTINCT namespace, ',' ORDER BY namespace) AS modules FROM sym JOIN bl USING (fq_name) WHERE {FUNCS} GROUP BY 1")
def contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.contributors(starschema.graph(spark, sf_dir, blame=True).symbols)


@query("""WITH d AS (SELECT *, NOT regexp_matches(version, '[><=^~*|]|^latest$|^$') AS is_pinned FROM dep) SELECT ecosystem, count(*) AS total, count(*) FILTER (is_pinned) AS pinned, count(*) FILTER (NOT is_pinned) AS unpinned,
count(*) FILTER (is_dev) AS dev, count(*) FILTER (NOT is_dev) AS production FROM d GROUP BY 1""")
def dependency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dependency_rollup(starschema.dependencies(spark, sf_dir))


@query("""WITH c AS (SELECT namespace AS module, count(DISTINCT file_path) AS file_count, count(*) AS symbol_count FROM sym GROUP BY 1),
d AS (SELECT e.source AS module, string_agg(DISTINCT s.namespace, ',' ORDER BY s.namespace) AS depends_on FROM edge e JOIN sym s ON s.fq_name = e.target WHERE edge_type = 'imports' AND s.namespace <> e.source GROUP BY 1)
SELECT module, file_count, symbol_count, coalesce(depends_on, '') AS depends_on FROM c LEFT JOIN d USING (module)""")
def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.modules(starschema.graph(spark, sf_dir))


MODULE = """
mpair AS (SELECT a.namespace AS a, b.namespace AS b, count(*) AS n FROM edge e JOIN sym a ON a.fq_name = e.source JOIN sym b ON b.fq_name = e.target GROUP BY 1, 2),
mcount AS (SELECT namespace AS module, count(*) AS symbol_count, count(DISTINCT file_path) AS file_count, count(*) FILTER (kind IN ('method', 'constructor')) AS method_count,
  count(*) FILTER (kind IN ('class', 'struct', 'enum', 'record', 'interface')) AS class_count, sum((kind = 'interface')::INT + contains(mods, 'abstract')::INT)::BIGINT AS abstract_count FROM sym GROUP BY 1),
mout AS (SELECT a AS module, count(*) AS efferent, sum(n)::BIGINT AS n, string_agg(b, ',' ORDER BY b) AS depends_on FROM mpair WHERE a <> b GROUP BY 1),
min_ AS (SELECT b AS module, count(*) AS afferent, sum(n)::BIGINT AS n FROM mpair WHERE a <> b GROUP BY 1),
mraw AS (SELECT m.*, coalesce(i.afferent, 0) AS afferent, coalesce(o.efferent, 0) AS efferent, coalesce(s.n, 0)::BIGINT AS intra_edges, (coalesce(i.n, 0) + coalesce(o.n, 0))::BIGINT AS inter_edges, coalesce(depends_on, '') AS depends_on
  FROM mcount m LEFT JOIN mout o USING (module) LEFT JOIN min_ i USING (module) LEFT JOIN (SELECT a AS module, n FROM mpair WHERE a = b) s USING (module)),
mderived AS (SELECT *, CASE WHEN afferent + efferent > 0 THEN efferent::DOUBLE / (afferent + efferent) ELSE 0.0 END AS ins, CASE WHEN class_count > 0 THEN abstract_count::DOUBLE / class_count ELSE 0.0 END AS ab,
  CASE WHEN intra_edges + inter_edges > 0 THEN intra_edges::DOUBLE / (intra_edges + inter_edges) ELSE 0.0 END AS coh FROM mraw),
mmet AS (SELECT module, symbol_count, file_count, method_count, class_count, abstract_count, afferent, efferent, intra_edges, inter_edges, depends_on, round(ins, 6) AS instability, round(ab, 6) AS abstractness,
  round(abs(ab + ins - 1), 6) AS distance, round(coh, 6) AS cohesion FROM mderived)
"""


@query("WITH " + MODULE + "SELECT * FROM mmet")
def module_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.module_metrics(starschema.graph(spark, sf_dir))


@query("WITH " + MODULE + "SELECT count(*) AS modules, round(avg(instability), 3) AS avg_instability, round(avg(abstractness), 3) AS avg_abstractness, round(avg(distance), 3) AS avg_distance, round(avg(cohesion), 3) AS avg_cohesion FROM mmet")
def coupling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.coupling_summary(metrics.module_metrics(starschema.graph(spark, sf_dir)))


NS = "nsdep AS (SELECT DISTINCT a.namespace AS a, b.namespace AS b FROM edge e JOIN sym a ON a.fq_name = e.source JOIN sym b ON b.fq_name = e.target WHERE edge_type IN ('calls', 'uses', 'imports') AND a.namespace <> b.namespace)\n"
CD = """par AS (SELECT fq_name, coalesce(parent, '') AS parent FROM sym),
cdep AS (SELECT DISTINCT a, b FROM (SELECT CASE WHEN coalesce(x.parent, '') <> '' THEN x.parent ELSE regexp_extract(source, '^(.*)[.][^.]*$', 1) END AS a, CASE WHEN coalesce(y.parent, '') <> '' THEN y.parent ELSE regexp_extract(target, '^(.*)[.][^.]*$', 1) END AS b
  FROM edge e LEFT JOIN par x ON x.fq_name = source LEFT JOIN par y ON y.fq_name = target WHERE edge_type IN ('calls', 'uses')) WHERE a <> '' AND b <> '' AND a <> b)
"""


@query("WITH " + NS + "SELECT * FROM nsdep")
def cross_namespace_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.namespace_dependencies(starschema.graph(spark, sf_dir))


@query("WITH " + NS + "SELECT x.a, x.b FROM nsdep x JOIN nsdep y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def namespace_two_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.two_cycles(metrics.namespace_dependencies(starschema.graph(spark, sf_dir)))


@query("WITH " + CD + "SELECT x.a, x.b FROM cdep x JOIN cdep y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def class_two_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.two_cycles(metrics.class_dependencies(starschema.graph(spark, sf_dir)))


@query("SELECT * FROM (SELECT source AS owner, target AS fq_name, start_line, row_number() OVER (PARTITION BY source ORDER BY start_line, target) AS row FROM edge JOIN sym ON fq_name = target WHERE edge_type = 'contains') WHERE row <= 10")
def members_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.members_page(starschema.graph(spark, sf_dir))


# ---- traversals -----------------------------------------------------------------------------

SEEDS = "seed AS (SELECT target AS node FROM edge WHERE edge_type = 'calls' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)\n"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three names with most calls in."""
    calls = starschema.graph(spark, sf_dir).of_type("calls")
    return calls.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(3).select("node")


@query("WITH " + SEEDS + """, near AS (SELECT target AS node, 'caller' AS relation, source AS fq_name FROM edge WHERE edge_type = 'calls' UNION ALL SELECT source, 'callee', target FROM edge WHERE edge_type = 'calls'
UNION ALL SELECT source, 'child', target FROM edge WHERE edge_type = 'contains')
SELECT DISTINCT node, relation, fq_name FROM near WHERE node IN (SELECT node FROM seed) AND fq_name IN (SELECT fq_name FROM sym)""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.neighbours(starschema.graph(spark, sf_dir), _seeds(spark, sf_dir))


def _walk(links: str, depth: int) -> str:
    return f"lnk AS ({links}), walk AS (SELECT node, 0 AS distance FROM seed UNION SELECT l.b, distance + 1 FROM walk JOIN lnk l ON l.a = node WHERE distance < {depth}), dist AS (SELECT node, min(distance) AS distance FROM walk GROUP BY 1)\n"


CALLS_OUT = "SELECT DISTINCT source AS a, target AS b FROM edge WHERE edge_type = 'calls'"
CALLS_IN = "SELECT DISTINCT target AS a, source AS b FROM edge WHERE edge_type = 'calls'"


@query("WITH " + SEEDS + ", " + _walk(f"{CALLS_OUT} UNION {CALLS_IN}", 2) + "SELECT node, distance FROM dist", recursive=True)
def neighborhood_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.neighborhood(starschema.graph(spark, sf_dir), _seeds(spark, sf_dir), 2)


@query("WITH " + SEEDS + ", " + _walk(CALLS_IN, 3) + "SELECT node AS fq_name, distance FROM dist WHERE distance > 0 AND node IN (SELECT fq_name FROM sym) ORDER BY distance, fq_name LIMIT 50", recursive=True)
def impact_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.impact(starschema.graph(spark, sf_dir), _seeds(spark, sf_dir))


@query("WITH " + SEEDS + ", " + _walk(CALLS_OUT, 4) + "SELECT node AS fq_name, distance AS depth FROM dist ORDER BY depth, fq_name LIMIT 30", recursive=True)
def flow_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.flow(starschema.graph(spark, sf_dir), _seeds(spark, sf_dir), 30, 4)


_ROOT_LIST = ", ".join(f"'{n}'" for n in traverse.ROOT_NAMES)
REACHED = f"""
seed AS (SELECT fq_name AS node FROM sym WHERE name IN ({_ROOT_LIST}) OR kind = 'constructor' OR starts_with(name, 'test') OR starts_with(name, 'Test') OR contains(mods, 'public') OR contains(mods, 'export') OR contains(mods, 'api')
  OR (kind = 'method' AND name = 'Main' AND contains(mods, 'static')) OR (kind = 'class' AND name IN ('Startup', 'Program'))),
lnk AS (SELECT DISTINCT source AS a, target AS b FROM edge WHERE edge_type <> 'imports' AND target IN (SELECT fq_name FROM sym)),
reach AS (SELECT node FROM seed UNION SELECT b FROM reach JOIN lnk ON a = node),
sreach AS (SELECT s.*, fq_name IN (SELECT node FROM reach) AS is_reached FROM sym s)
"""


@query("WITH " + REACHED + "SELECT fq_name, is_reached FROM sreach", recursive=True)
def reachable_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.reached(starschema.graph(spark, sf_dir)).select("fq_name", "is_reached")


@query("WITH " + REACHED + f"SELECT fq_name, file_path, start_line FROM sreach WHERE NOT is_reached AND {FUNCS}", recursive=True)
def unreachable_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.reached(starschema.graph(spark, sf_dir)).filter(F.col("kind").isin("method", "constructor") & ~F.col("is_reached")).select("fq_name", "file_path", "start_line")


@query("WITH " + REACHED + f"""SELECT count(*) AS symbols, count(*) FILTER (is_reached) AS n_reached, count(*) FILTER (NOT is_reached AND {FUNCS}) AS dead_functions,
count(*) FILTER (NOT is_reached AND kind IN ('class', 'struct', 'interface', 'enum')) AS dead_types FROM sreach""", recursive=True)
def dead_code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.dead_code_summary(traverse.reached(starschema.graph(spark, sf_dir)))


@query("WITH " + REACHED + "SELECT namespace AS module, count(*) AS symbols, count(DISTINCT file_path) AS files FROM sreach GROUP BY 1 HAVING count(*) FILTER (is_reached) = 0", recursive=True)
def dead_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.dead_modules(traverse.reached(starschema.graph(spark, sf_dir)))


@query("WITH " + REACHED + "SELECT DISTINCT source, target, e.file_path FROM edge e JOIN sreach s ON s.fq_name = target WHERE edge_type = 'imports' AND NOT is_reached", recursive=True)
def dead_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = starschema.graph(spark, sf_dir)
    return traverse.dead_imports(g, traverse.reached(g))


DEPTH = """up AS (SELECT source AS fq_name, max(target) AS base FROM edge WHERE edge_type = 'inherits' GROUP BY 1),
climb AS (SELECT fq_name, base AS at, 1 AS depth FROM up UNION ALL SELECT c.fq_name, u.base, depth + 1 FROM climb c JOIN up u ON u.fq_name = c.at WHERE depth < 60),
depths AS (SELECT fq_name, max(depth) AS depth FROM climb GROUP BY 1)
"""


@query("WITH " + DEPTH + "SELECT fq_name, depth FROM depths", recursive=True)
def inheritance_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.inheritance_depth(starschema.graph(spark, sf_dir))


CYC = """mlink AS (SELECT DISTINCT a, b FROM mpair WHERE a <> b), clo AS (SELECT a, b FROM mlink UNION SELECT c.a, l.b FROM clo c JOIN mlink l ON l.a = c.b),
scc AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM clo x JOIN clo y ON x.a = y.b AND x.b = y.a GROUP BY 1),
cyc AS (SELECT component, count(*) AS size, string_agg(node, ',' ORDER BY node) AS members FROM scc GROUP BY 1 HAVING count(*) > 1)
"""


@query("WITH " + MODULE + ", " + CYC + "SELECT * FROM cyc", recursive=True)
def module_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.cycles(metrics.module_dependencies(starschema.graph(spark, sf_dir)))


# ---- rules ----------------------------------------------------------------------------------

#: Thresholds under which the derived graph has findings of most rules.
LIMITS = {"max_fan_out": 3, "max_fan_in": 3, "max_children": 12, "max_god_class_methods": 8, "max_commit_count": 3, "max_class_lines": 100, "max_method_lines": 20, "max_parameters": 4, "max_inheritance_depth": 3}
AS_OF = "2025-01-20"


def _words(words, test: str = "contains", column: str = "lower(name)") -> str:
    return "(" + " OR ".join(f"{test}({column}, '{w}')" for w in words) + ")"


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


RULE_TABLES = (
    FAN + ", " + BLAMED + ", " + REACHED + ", " + DEPTH + ", " + MODULE + ", " + CYC + ", " + NS + ", " + CD
    + """,
kid AS (SELECT source AS owner, c.* FROM edge JOIN sym c ON c.fq_name = target WHERE edge_type = 'contains'),
kids AS (SELECT owner, count(*) AS n_children, count(*) FILTER (kind = 'method') AS n_methods, count(*) FILTER (kind IN ('method', 'constructor')) AS n_funcs, count(*) FILTER (kind = 'field') AS n_fields,
  count(*) FILTER (kind = 'field' AND contains(mods, 'public')) AS n_public_fields, count(*) FILTER (kind = 'method' AND return_type IN ('void', '', 'None', 'unit', '()', 'Unit')) AS n_void,
  count(*) FILTER (kind = 'method' AND contains(mods, 'static')) AS n_static, count(*) FILTER (contains(name, '_') AND name <> upper(name)) AS n_snake,
  count(*) FILTER (NOT (contains(name, '_') AND name <> upper(name)) AND regexp_matches(name, '^[a-z].*[A-Z]')) AS n_camel FROM kid GROUP BY 1),
pc AS (SELECT c.source, c.target, a.parent AS sp, b.parent AS tp, a.kind AS sk FROM cll c JOIN sym a ON a.fq_name = c.source JOIN sym b ON b.fq_name = c.target),
td AS (SELECT k.owner, p.source, p.target, p.tp, p.sk FROM kid k JOIN pc p ON p.source = k.fq_name),
tdeps AS (SELECT owner, count(DISTINCT target) AS n_deps, count(DISTINCT CASE WHEN i.kind = 'interface' THEN target END) AS n_ideps, count(DISTINCT CASE WHEN tp <> owner THEN tp END) AS cbo FROM td JOIN sym i ON i.fq_name = target GROUP BY 1),
tsing AS (SELECT owner, count(*) FILTER (n = 1) AS singles, max(dc) AS delegates FROM (SELECT owner, source, count(*) AS n FROM td WHERE sk = 'method' GROUP BY 1, 2) JOIN (SELECT owner, count(DISTINCT tp) AS dc FROM td WHERE sk = 'method' GROUP BY 1) USING (owner) GROUP BY 1),
tpair AS (SELECT owner, count(*) AS pairs FROM (SELECT DISTINCT x.owner, x.source, y.source AS other FROM td x JOIN td y ON x.owner = y.owner AND x.target = y.target AND x.source < y.source WHERE x.sk = 'method' AND y.sk = 'method') GROUP BY 1),
typ AS (SELECT s.fq_name, s.file_path, s.start_line AS line, coalesce(n_children, 0) AS n_children, coalesce(n_methods, 0) AS n_methods, coalesce(n_funcs, 0) AS n_funcs, coalesce(n_fields, 0) AS n_fields,
  coalesce(n_public_fields, 0) AS n_public_fields, coalesce(n_void, 0) AS n_void, coalesce(n_static, 0) AS n_static, coalesce(n_snake, 0) AS n_snake, coalesce(n_camel, 0) AS n_camel, coalesce(n_deps, 0) AS n_deps,
  coalesce(n_ideps, 0) AS n_ideps, coalesce(cbo, 0) AS cbo, coalesce(singles, 0) AS singles, coalesce(delegates, 0) AS delegates, coalesce(pairs, 0) AS pairs, coalesce(depth, 0) AS depth,
  s.fq_name IN (SELECT target FROM edge) OR s.fq_name IN (SELECT source FROM edge WHERE edge_type = 'contains') AS referenced
  FROM sym s LEFT JOIN kids k ON k.owner = s.fq_name LEFT JOIN tdeps d ON d.owner = s.fq_name LEFT JOIN tsing t ON t.owner = s.fq_name LEFT JOIN tpair p ON p.owner = s.fq_name LEFT JOIN depths h ON h.fq_name = s.fq_name
  WHERE s.kind IN ('class', 'struct')),
ifc AS (SELECT s.fq_name, s.file_path, s.start_line AS line, coalesce(n_children, 0) AS n_children, (SELECT count(*) FROM edge WHERE edge_type = 'implements' AND target = s.fq_name) AS n_impl FROM sym s LEFT JOIN kids k ON k.owner = s.fq_name WHERE s.kind = 'interface'),
envy AS (SELECT source AS fq_name, sum(n) AS calls_out, coalesce(sum(n) FILTER (tp = sp), 0) AS own, coalesce(max(n) FILTER (tp <> sp), 0) AS far FROM (SELECT source, sp, tp, count(*) AS n FROM pc WHERE sp IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1),
inb AS (SELECT target AS fq_name, count(*) AS calls_in, count(DISTINCT sp) AS caller_classes FROM pc GROUP BY 1),
impl AS (SELECT source AS fq_name, count(*) AS n_implements FROM edge WHERE edge_type = 'implements' GROUP BY 1),
cl AS (SELECT fp, count(*) AS members, min(fq_name) AS head FROM sym WHERE kind IN ('method', 'constructor') AND end_line - start_line + 1 >= 5 AND fp <> '' GROUP BY 1),
fat AS (SELECT s.*, s.start_line AS line, s.kind IN ('method', 'constructor') AS is_func, s.kind IN ('class', 'struct') AS is_type, coalesce(calls_out, 0) AS calls_out, coalesce(own, 0) AS own, coalesce(far, 0) AS far, coalesce(calls_in, 0) AS calls_in,
  coalesce(caller_classes, 0) AS caller_classes, coalesce(n_implements, 0) AS n_implements, coalesce(members, 0) AS members, head, coalesce(commit_count, 0) AS commits, last_author, r.is_reached,
  CASE WHEN last_modified_at IS NULL THEN -1 ELSE date_diff('day', last_modified_at::DATE, DATE '""" + AS_OF + """') END AS age
  FROM sfan s JOIN (SELECT fq_name, is_reached FROM sreach) r USING (fq_name) LEFT JOIN envy USING (fq_name) LEFT JOIN inb USING (fq_name) LEFT JOIN impl USING (fq_name)
  LEFT JOIN cl ON cl.fp = s.fp AND s.kind IN ('method', 'constructor') AND loc >= 5 AND s.fp <> '' LEFT JOIN bl USING (fq_name)),
modl AS (SELECT m.*, att, att_files, authors, n_reached, path FROM mmet m JOIN (SELECT namespace AS module, count(*) FILTER (is_func AND last_author IS NOT NULL) AS att, count(DISTINCT CASE WHEN is_func AND last_author IS NOT NULL THEN file_path END) AS att_files,
  count(DISTINCT CASE WHEN is_func THEN last_author END) AS authors, count(*) FILTER (is_reached) AS n_reached, min(file_path) AS path FROM fat GROUP BY 1) USING (module)),
fil AS (SELECT coalesce(a.file_path, b.file_path) AS file_path, coalesce(n, 0) AS symbols, coalesce(i, 0) AS imports FROM (SELECT file_path, count(*) AS n FROM sym GROUP BY 1) a FULL JOIN (SELECT file_path, count(DISTINCT target) AS i FROM edge WHERE edge_type = 'imports' GROUP BY 1) b ON a.file_path = b.file_path),
imp AS (SELECT lower(target) AS x FROM edge WHERE edge_type = 'imports' UNION SELECT split_part(lower(target), '.', 1) FROM edge WHERE edge_type = 'imports' UNION SELECT split_part(lower(namespace), '.', 1) FROM sym)
"""
)

#: Per rule: table, condition, value; the thresholds are those of LIMITS.
_C = rules.CONFIG | LIMITS
RULE_SQL = {
    "CC001": ("fat", f"is_func AND loc > {_C['max_method_lines']}", "loc"),
    "CC002": ("fat", f"is_type AND loc > {_C['max_class_lines']}", "loc"),
    "CC003": ("fat", f"is_func AND n_params > {_C['max_parameters']}", "n_params"),
    "CC004": ("fat", "is_func AND loc <= 2", "loc"),
    "CC005": ("fat", "kind = 'constructor' AND n_params > 4", "n_params"),
    "CC006": ("typ", "n_methods >= 4 AND n_void::DOUBLE / n_methods > 0.7", "n_void"),
    "CC007": ("typ", "n_methods >= 4 AND n_static::DOUBLE / n_methods > 0.5", "n_static"),
    "CC008": ("typ", "n_public_fields >= 5", "n_public_fields"),
    "SOLID001": ("typ", f"n_funcs > {_C['max_god_class_methods']}", "n_funcs"),
    "SOLID002": ("typ", f"depth >= {_C['max_inheritance_depth']}", "depth"),
    "SOLID003": ("ifc", f"n_children > {_C['max_parameters']}", "n_children"),
    "SOLID004": ("typ", "n_deps > 3 AND n_ideps = 0 AND EXISTS (SELECT 1 FROM ifc)", "n_deps"),
    "AR003": ("fat", "n_implements > 3", "n_implements"),
    "CX001": ("fat", f"is_func AND fan_out > {_C['max_fan_out']}", "fan_out"),
    "CX002": ("fat", f"fan_in > {_C['max_fan_in']}", "fan_in"),
    "CX003": ("typ", f"n_children > {_C['max_children']}", "n_children"),
    "MT001": ("typ", f"cbo > {_C['max_fan_out']}", "cbo"),
    "MT002": ("typ", "n_methods >= 4 AND pairs / (n_methods * (n_methods - 1) / 2.0) < 0.2", "pairs"),
    "MT003": ("fat", "kind = 'method' AND loc >= 5 AND fan_out >= 5 AND fan_out::DOUBLE / loc > 0.5", "fan_out"),
    "CX004": ("fat", "is_func AND cc > 15", "cc"),
    "CX005": ("fat", "is_func AND cc > 30", "cc"),
    "CX006": ("fat", "is_func AND cog > 20", "cog"),
    "CX007": ("fat", "is_func AND cog > 40", "cog"),
    "CX008": ("fat", "is_func AND loc >= 3 AND cc >= 3 AND cc::DOUBLE / loc > 0.5", "cc"),
    "DS001": ("(SELECT x.a || ' <-> ' || x.b AS fq_name, '' AS file_path, 0 AS line FROM cdep x JOIN cdep y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b)", "true", "0"),
    "DS002": ("typ", "NOT referenced", "0"),
    "SM001": ("fat", f"kind = 'method' AND fan_in = 0 AND NOT starts_with(name, 'test') AND name NOT IN {_list(rules.ENTRY_METHODS)}", "0"),
    "SM002": ("fat", "kind = 'method' AND parent IS NOT NULL AND calls_out >= 3 AND far >= 3 AND far > own", "far"),
    "SM003": ("typ", "n_children >= 3 AND n_fields >= 4 AND n_fields::DOUBLE / (n_fields + n_funcs) >= 0.8", "n_fields"),
    "SM004": ("fat", "kind = 'method' AND calls_in >= 5 AND caller_classes >= 5", "caller_classes"),
    "SM005": ("typ", "n_methods >= 3 AND singles = n_methods AND delegates = 1", "n_methods"),
    "SM006": ("ifc", "n_impl <= 1", "n_impl"),
    "SM007": ("typ", "n_funcs = 1 AND n_children <= 2", "n_children"),
    "AR001": ("(SELECT x.a || ' <-> ' || x.b AS fq_name, '' AS file_path, 0 AS line FROM nsdep x JOIN nsdep y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b)", "true", "0"),
    "DOC001": ("fat", "kind IN ('class', 'interface', 'struct', 'method') AND (contains(mods, 'public') OR mods = '') AND doc_comment = ''", "0"),
    "NM001": ("fat", f"kind <> 'field' AND length(name) <= 2 AND lower(name) NOT IN {_list(rules.SHORT_NAMES)}", "length(name)"),
    "NM002": ("fat", f"kind = 'method' AND return_type IN {_list(rules.BOOL_TYPES)} AND NOT {_words(rules.BOOL_PREFIXES, 'starts_with')}", "0"),
    "NM003": ("typ", "n_snake >= 2 AND n_camel >= 2", "n_snake"),
    "NM004": ("fat", "regexp_matches(name, '^(?i:" + "|".join(rules.HUNGARIAN) + ")[A-Z_]')", "0"),
    "BP001": ("(SELECT '' AS fq_name, file_path, 1 AS line, symbols FROM fil)", "symbols > 30", "symbols"),
    "BP002": ("(SELECT '' AS fq_name, file_path, 1 AS line, imports FROM fil)", "imports > 15", "imports"),
    "AR002": ("(SELECT namespace AS fq_name, min(file_path) AS file_path, 1 AS line, len(string_split(namespace, '.')) AS segments FROM sym GROUP BY namespace)", "segments > 5", "segments"),
    "SEC001": ("fat", f"kind = 'field' AND {_words(rules.SECRET_NAMES)} AND lower(return_type) IN ('string', 'str', '&str')", "0"),
    "SEC002": ("fat", f"kind = 'method' AND name IN {_list(rules.RAW_SQL)}", "0"),
    "SEC003": ("fat", f"kind = 'field' AND contains(mods, 'public') AND {_words(rules.SENSITIVE)}", "0"),
    "DEP001": ("(SELECT ecosystem || ':' || name AS fq_name, file_path, 0 AS line, version FROM dep)", "version IN ('*', 'latest', '')", "0"),
    "DEP002": ("(SELECT ecosystem || ':' || name AS fq_name, file_path, 0 AS line, version FROM dep)", "starts_with(version, '>=') AND NOT contains(version, '<')", "0"),
    "DEP003": ("(SELECT ecosystem || ':' || name AS fq_name, file_path, 0 AS line, name, is_dev FROM dep)", "NOT is_dev AND replace(replace(name, '-', '_'), '.', '_') NOT IN (SELECT x FROM imp)", "0"),
    "DEP004": ("(SELECT ecosystem || ':' || name AS fq_name, min(file_path) AS file_path, 0 AS line, count(DISTINCT file_path) AS files FROM dep GROUP BY ecosystem, name)", "files > 1", "files"),
    "DEP005": ("(SELECT source || ' -> ' || target AS fq_name, file_path, 0 AS line, target FROM edge WHERE edge_type = 'imports' AND NOT contains(file_path, 'test'))", "split_part(replace(lower(target), '-', '_'), '.', 1) IN (SELECT name FROM dep WHERE is_dev)", "0"),
    "GB001": ("fat", "is_func AND commits >= 5 AND cc >= 10", "commits"),
    "GB002": ("fat", "is_func AND age >= 365 AND calls_in = 0", "age"),
    "GB003": ("(SELECT module AS fq_name, path AS file_path, 0 AS line, * FROM modl)", "att >= 5 AND att_files >= 2 AND authors = 1", "att"),
    "GB004": ("fat", f"is_func AND commits > {_C['max_commit_count']}", "commits"),
    "DC001": ("fat", "is_func AND NOT is_reached", "0"),
    "DC002": ("fat", "kind IN ('class', 'struct', 'interface', 'enum') AND NOT is_reached", "0"),
    "DC003": ("(SELECT module AS fq_name, path AS file_path, 0 AS line, * FROM modl)", "n_reached = 0", "symbol_count"),
    "DC004": ("(SELECT DISTINCT source || ' -> ' || target AS fq_name, e.file_path, 0 AS line FROM edge e JOIN sreach s ON s.fq_name = target WHERE edge_type = 'imports' AND NOT is_reached)", "true", "0"),
    "DUP001": ("fat", "members >= 2", "members"),
    "DUP003": ("fat", "members > 3 AND head = fq_name", "members"),
    "MC001": ("(SELECT module AS fq_name, path AS file_path, 0 AS line, * FROM modl)", "symbol_count >= 3 AND instability > 0.8", "instability"),
    "MC002": ("(SELECT module AS fq_name, path AS file_path, 0 AS line, * FROM modl)", "symbol_count >= 5 AND intra_edges + inter_edges >= 3 AND cohesion < 0.3", "cohesion"),
    "MC003": ("(SELECT module AS fq_name, path AS file_path, 0 AS line, * FROM modl)", "class_count >= 2 AND instability < 0.2 AND abstractness < 0.2", "instability"),
    "MC004": ("(SELECT module AS fq_name, path AS file_path, 0 AS line, * FROM modl)", "class_count >= 2 AND instability > 0.8 AND abstractness > 0.8", "instability"),
    "MC005": ("(SELECT members AS fq_name, '' AS file_path, 0 AS line, size FROM cyc)", "true", "size"),
}


def _findings_sql(ids: list[str]) -> str:
    parts = []
    for i in ids:
        r, (source, when, value) = rules.RULES[i], RULE_SQL[i]
        parts.append(f"SELECT '{i}' AS rule_id, '{r.name}' AS rule_name, '{r.category}' AS category, '{r.severity}' AS severity, fq_name AS symbol_fq_name, file_path, line::INT AS line, round(({value})::DOUBLE, 6) AS value FROM {source} q WHERE {when}")
    return "WITH " + RULE_TABLES + ", found AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")\n"


def _category(category: str):
    ids = [i for i in RULE_SQL if rules.RULES[i].category == category]

    @query(_findings_sql(ids) + "SELECT * FROM found", name=f"rules_{category}", recursive=True)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rules.findings(starschema.graph(spark, sf_dir, blame=True), LIMITS, [category], as_of=AS_OF)

    run.__doc__ = f"All findings of the {category} rules."
    return run


for _name in rules.CATEGORIES:
    _category(_name)


@query(_findings_sql(list(RULE_SQL)) + "SELECT severity, rule_id, count(*) AS findings FROM found GROUP BY 1, 2", recursive=True)
def health_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(starschema.graph(spark, sf_dir, blame=True), LIMITS, as_of=AS_OF, per=("severity", "rule_id")).withColumnRenamed("n", "findings")


@query(
    _findings_sql(list(RULE_SQL))
    + f""", nsym AS (SELECT greatest(count(*), 1) AS n FROM sym), cats AS (SELECT unnest({list(rules.CATEGORIES)}) AS scope)
SELECT scope, count(rule_id) AS findings, round(greatest(0.0, 100 * (1 - count(rule_id)::DOUBLE / (SELECT n FROM nsym))), 1) AS score FROM cats LEFT JOIN found ON category = scope GROUP BY scope
UNION ALL SELECT 'overall', count(*), round(greatest(0.0, 100 - 10 * sum(CASE severity WHEN 'critical' THEN 10 WHEN 'error' THEN 5 WHEN 'warning' THEN 2 ELSE 1 END)::DOUBLE / (SELECT n FROM nsym)), 1) FROM found""",
    recursive=True,
)
def health_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = starschema.graph(spark, sf_dir, blame=True)
    return rules.counted_scores(rules.findings(g, LIMITS, as_of=AS_OF, per=("category", "severity")), g.symbols)


__all__ = ["QUERIES"]
