"""Queries over accounts, stored tables, exports and generated documents. Their bindings read every row of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..operators import accounts, documents, similarity, store
from ..sources import code, starschema
from ..sources import files as file_source
from ..sources.starschema import table
from .graph_queries import FAN
from .other_queries import UNITS, VECTORS, _units
from .registry import query

AS_OF = "1999-06-01 00:00:00"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _list(items) -> str:
    return "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in items) + "]"


def _at(items, key: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in items]), (key % len(items) + 1).cast("int"))


# ---- accounts -------------------------------------------------------------------------------------

#: Customers are users, whose role is their segment's; suppliers are repositories, owned by the customer of the same number.
USERS = f"usr AS (SELECT c_custkey AS user_id, ({_list(accounts.ROLES)})[list_position({_list(SEGMENTS)}, c_mktsegment)] AS role FROM customer)\n"


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.create_map(*[F.lit(x) for pair in zip(SEGMENTS, accounts.ROLES) for x in pair])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.try_element_at(roles, F.col("c_mktsegment")).alias("role"))


@query("WITH " + USERS + """SELECT DISTINCT o_custkey AS user_id, l_suppkey AS repo_id, coalesce(u.user_id IS NOT NULL AND (role IN ('admin', 'superadmin') OR l_suppkey = o_custkey AND l_suppkey IN (SELECT s_suppkey FROM supplier)), false) AS allowed
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN usr u ON u.user_id = o_custkey""", prelude=False)
def repo_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    requests = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("repo_id")).join(o, "l_orderkey").select("user_id", "repo_id").distinct()
    repos = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("repo_id"), F.col("s_suppkey").alias("owner_id"))
    return accounts.access(requests, _users(spark, sf_dir), repos)


@query("WITH " + USERS + "SELECT * FROM usr WHERE role IN ('support', 'superadmin')", prelude=False)
def allowed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.allowed_roles(_users(spark, sf_dir), "support", "superadmin")


URLS = ("https://host.example/a", "http://LOCALHOST:80/a", "ftp://host.example/a", "https://me@127.0.0.1/a", "http://[::1]:8/a", "no address", None, "HTTPS://Host.example?x", "http:///a")
BRANCHES = ("main", " dev ", "", "a..b", "/a", None, "b" * 129)
HOSTS = (("GitHub ", True), ("gitlab", True), ("svn", False), (None, True), ("", False))


@query(f"""SELECT p_partkey AS id, trim(p_name) AS name, url, trim(coalesce(branch, 'main')) AS default_branch, lower(trim(coalesce(provider, 'github'))) AS git_provider, concat_ws(',', CASE WHEN trim(p_name) = '' THEN 'name' END,
CASE WHEN p_partkey % 9 NOT IN (0, 7) THEN 'url' END, CASE WHEN p_size % 7 NOT IN (0, 1, 5) THEN 'default_branch' END, CASE WHEN p_size % 5 IN (2, 4) THEN 'git_provider' END, CASE WHEN 30 * p_size > 1024 THEN 'git_token' END) AS reasons
FROM (SELECT *, ({_list(URLS)})[p_partkey % 9 + 1] AS url, ({_list(BRANCHES)})[p_size % 7 + 1] AS branch, ({_list(h for h, _ in HOSTS)})[p_size % 5 + 1] AS provider FROM part)""", prelude=False)
def validated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL knows which of the made-up values are bad; the operator finds out."""
    p = table(spark, sf_dir, "part")
    r = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), _at(URLS, F.col("p_partkey")).alias("url"), _at(BRANCHES, F.col("p_size")).alias("default_branch"), _at([h for h, _ in HOSTS], F.col("p_size")).alias("git_provider"), F.repeat(F.lit("t"), 30 * F.col("p_size")).alias("git_token"))
    return accounts.validated(r).drop("git_token").withColumn("reasons", F.array_join("reasons", ","))


#: Orders are subscriptions to the plan of their priority, active unless they are finished.
PLANS = {
    "1-URGENT": '{"type": "time_based", "trial_days": 900}', "2-HIGH": '{"type": "combo", "trial_days": 30, "daily_tokens": 500, "daily_scans": 3}', "3-MEDIUM": '{"type": "token_based", "daily_tokens": 1000}',
    "4-NOT SPECIFIED": "{broken", "5-LOW": '{"type": "unlimited"}',
}
KNOWN = ("time_based", 900, 0, 0), ("combo", 30, 500, 3), ("token_based", 0, 1000, 0), ("unlimited", 0, 0, 0), ("unlimited", 0, 0, 0)
ACTIVE = "pl AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{k[0]}', {k[1]}::INT, {k[2]}::BIGINT, {k[3]}::BIGINT)" for p, k in zip(PLANS, KNOWN)) + """) t(plan_id, limit_type, trial_days, daily_tokens, daily_scans)),
act AS (SELECT o_custkey AS user_id, plan_id, o_orderdate AS started_at, limit_type, trial_days, daily_tokens, daily_scans FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) JOIN pl ON plan_id = o_orderpriority)
"""


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("plan_id"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderstatus") != "F").alias("is_active"))
    return accounts.active_plans(s, spark.createDataFrame(list(PLANS.items()), "plan_id string, limits string"))


@query("WITH " + ACTIVE + "SELECT * FROM act", prelude=False)
def active_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _active(spark, sf_dir)


@query("WITH " + ACTIVE + f"""SELECT user_id, plan_id, trial_days > 0 AND TIMESTAMP '{AS_OF}' >= started_at + to_days(trial_days) AS expired,
CASE WHEN trial_days > 0 AND TIMESTAMP '{AS_OF}' < started_at + to_days(trial_days) THEN floor(epoch(started_at + to_days(trial_days) - TIMESTAMP '{AS_OF}') / 86400)::INT END AS days_left FROM act""", prelude=False)
def trial_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.trials(_active(spark, sf_dir), AS_OF).select("user_id", "plan_id", "expired", "days_left")


@query(f"SELECT 'users' AS item, count(*) AS n FROM customer UNION ALL SELECT 'repos', count(*) FROM supplier UNION ALL SELECT 'parsers', {len(code.PARSERS)}", prelude=False)
def system_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.system_totals(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), len(code.PARSERS))


PAYLOADS = (
    ("github", "push", '{"repository": {"clone_url": "https://h/%.git"}, "ref": "refs/heads/main", "after": "c1"}', "https://h/%.git", "refs/heads/main", "c1", None),
    ("github", "ping", '{"repository": {"clone_url": "https://h/%"}, "ref": "main"}', "https://h/%", "main", None, "another event"),
    ("github", "push", '{"repository": {"clone_url": "", "html_url": "https://h/%/"}, "ref": "main"}', "https://h/%/", "main", None, None),
    ("gitlab", "Push Hook", '{"project": {"http_url": "https://h/%"}, "ref": "refs/heads/dev", "after": "c2"}', "https://h/%", "refs/heads/dev", "c2", None),
    ("gitlab", "Push Hook", '{"project": {}}', None, None, None, "no url"),
    ("other", None, '{"repo_url": "https://h/%", "branch": "dev", "commit_sha": "c3"}', "https://h/%", "dev", "c3", None),
    ("other", None, '{"repo_url": "https://h/%"}', "https://h/%", None, None, "no branch"),
)


@query("SELECT event_id AS id, " + ", ".join(f"replace(({_list(p[k] for p in PAYLOADS)})[event_id % 7 + 1], '%', 'r' || user_id) AS {c}" for c, k in (("provider", 0), ("url", 3), ("ref", 4), ("commit_sha", 5), ("reason", 6))) + " FROM events", prelude=False)
def push_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL knows what was put into the payloads; the operator reads it out of them."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    pick = lambda k: _at([p[k] for p in PAYLOADS], F.col("event_id"))
    hooks = e.select("event_id", pick(0).alias("provider"), pick(1).alias("event"), F.replace(pick(2), F.lit("%"), F.concat(F.lit("r"), F.col("user_id").cast("string"))).alias("payload"))
    return file_source.pushes(hooks).withColumnRenamed("event_id", "id")


# ---- stored tables --------------------------------------------------------------------------------


@query("SELECT vec_id AS id, 'stored' AS value FROM embeddings WHERE vec_id NOT IN (SELECT user_id FROM events) UNION ALL SELECT user_id, arg_max(event_type, event_id) FROM events GROUP BY 1", prelude=False)
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("stored").alias("value"))
    return store.upsert(old, table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("value"), "event_id"), ["id"], ["event_id"])


@query("""WITH al AS (SELECT event_type AS s, 'u' || user_id AS f, props AS note, CASE WHEN floor(value)::BIGINT % 2 = 0 THEN '' ELSE 'a' || floor(value)::BIGINT END AS author, ts AS tm, event_id AS id FROM events
UNION ALL SELECT 'click', 'u' || c_custkey, c_name, c_mktsegment, TIMESTAMP '2023-01-01', -1 FROM customer)
SELECT s AS snapshot_id, f AS fq_name, arg_max(note, row(id >= 0, tm, id)) AS note, coalesce(arg_max(author, row(id >= 0, tm, id)) FILTER (author <> ''), '') AS author, min(tm) AS created_at, max(tm) AS updated_at FROM al GROUP BY 1, 2""", prelude=False)
def notes_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    then = F.lit("2023-01-01").cast("timestamp_ntz")
    fq = lambda c: F.concat(F.lit("u"), F.col(c).cast("string")).alias("fq_name")
    notes = table(spark, sf_dir, "customer").select(F.lit("click").alias("snapshot_id"), fq("c_custkey"), F.col("c_name").alias("note"), F.col("c_mktsegment").alias("author"), then.alias("created_at"), then.alias("updated_at"))
    v = F.floor("value").cast("long")
    changes = table(spark, sf_dir, "events").select(F.col("event_type").alias("snapshot_id"), fq("user_id"), F.col("props").alias("note"), F.when(v % 2 == 0, "").otherwise(F.concat(F.lit("a"), v.cast("string"))).alias("author"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return store.put_notes(notes, changes)


@query("SELECT l_orderkey AS snapshot_id, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0)", prelude=False)
def cascading_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are snapshots of customers; those of customers in debt are deleted with all their lines."""
    of = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("repo_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), "l_partkey", "l_linenumber")
    return store.cascade({"lines": lines}, of, table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("repo_id")))["lines"]


@query("WITH " + VECTORS + "SELECT turn AS id, arg_max(vector, conv_id)[1:4] AS head FROM unit GROUP BY 1 UNION ALL SELECT -1 - label, list_transform(arg_max(embedding, vec_id)[1:4], lambda x: round(x::DOUBLE, 6)) FROM embeddings GROUP BY label", prelude=False)
def vectors_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored by label, and the last text of every turn, embedded and put in; the first four components."""
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.max_by("embedding", "vec_id").alias("v"))
    old = e.select((-1 - F.col("label")).cast("long").alias("id"), F.col("v").cast("array<double>").alias("vector"))
    new = table(spark, sf_dir, "conversations").select(F.col("turn").cast("long").alias("id"), "text", "conv_id")
    return store.put_vectors(old, new, ["conv_id"]).select("id", F.transform(F.slice("vector", 1, 4), lambda v: F.round(v, 6)).alias("head"))


# ---- exports and generated documents ----------------------------------------------------------------


@query("""SELECT 'symbols' AS section, file_path AS place, to_json({'fq_name': fq_name, 'name': name, 'kind': kind, 'file_path': file_path, 'start_line': start_line, 'end_line': end_line, 'namespace': namespace, 'parent_fq_name': coalesce(parent, ''), 'signature': signature, 'modifiers': mods, 'return_type': return_type})::VARCHAR AS json FROM sym
UNION ALL SELECT 'edges', file_path, to_json({'source_fq_name': source, 'target_fq_name': target, 'edge_type': edge_type, 'file_path': file_path, 'line': 0})::VARCHAR FROM edge
UNION ALL SELECT 'docs', source, to_json({'doc_type': lang, 'title': doc_id::VARCHAR, 'scope_id': source, 'markdown': md5(text)})::VARCHAR FROM documents
UNION ALL SELECT 'summaries', user_id::VARCHAR, to_json({'scope_type': event_type, 'scope_id': user_id::VARCHAR, 'summary': replace(props, ' ', '')::JSON})::VARCHAR FROM events
UNION ALL SELECT 'metadata', '', to_json({'symbol_count': (SELECT count(*) FROM sym), 'edge_count': (SELECT count(*) FROM edge), 'summary_count': (SELECT count(*) FROM events), 'doc_count': (SELECT count(*) FROM documents)})::VARCHAR""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("doc_type"), F.col("doc_id").cast("string").alias("title"), F.col("source").alias("scope_id"), F.md5(F.col("text").cast("binary")).alias("markdown"))
    said = table(spark, sf_dir, "events").select(F.col("event_type").alias("scope_type"), F.col("user_id").cast("string").alias("scope_id"), F.col("props").alias("summary_json"))
    return sinks.json_export(starschema.graph(spark, sf_dir), said, docs)


@query("WITH " + UNITS + """, gr AS (SELECT count(*) AS m FROM units GROUP BY fingerprint HAVING count(*) >= 2)
SELECT (SELECT count(*) FROM gr) AS groups, (SELECT coalesce(sum(m), 0)::BIGINT FROM gr) AS members, (SELECT count(*) FROM cls a JOIN cls b ON a.u < b.u AND list_has_any(a.windows, b.windows)
WHERE len(list_intersect(a.windows, b.windows))::DOUBLE / (len(a.windows) + len(b.windows) - len(list_intersect(a.windows, b.windows))) >= 0.6) AS pairs""", prelude=False)
def clone_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _units(spark, sf_dir)
    return similarity.totals(u.drop("windows"), similarity.near_pairs(u.select("unit", "windows")))


@query("SELECT regexp_extract(file_path, '([^.]*)$', 1) AS extension, count(*) AS n FROM sym GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.extension_counts(starschema.graph(spark, sf_dir))


@query("SELECT kind, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, kind) AS place FROM sym GROUP BY 1")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.kind_counts(starschema.graph(spark, sf_dir))


EXTERNAL = "ext AS (SELECT name FROM (SELECT coalesce(namespace, target) AS name FROM edge LEFT JOIN sym ON fq_name = target WHERE edge_type = 'imports' UNION SELECT name FROM dep) WHERE name NOT IN (SELECT namespace FROM sym))\n"


@query("WITH " + EXTERNAL + "SELECT * FROM ext")
def external_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.external_dependencies(starschema.graph(spark, sf_dir))


@query("SELECT source AS scope, array_to_string(list_filter(['architecture', 'readme', 'runbook'], lambda t: NOT list_contains(list(CASE lang WHEN 'en' THEN 'readme' WHEN 'de' THEN 'runbook' ELSE lang END), t)), ',') AS missing FROM documents GROUP BY 1", prelude=False)
def missing_doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.when(F.col("lang") == "en", "readme").when(F.col("lang") == "de", "runbook").otherwise(F.col("lang")).alias("doc_type"))
    return documents.missing_types(d, d).withColumn("missing", F.array_join("missing", ","))


MODULES = """mods AS (SELECT namespace AS module, count(*) AS symbols, count(DISTINCT file_path) AS files FROM sym GROUP BY 1),
mdep AS (SELECT DISTINCT e.source AS module, s.namespace AS d FROM edge e JOIN sym s ON s.fq_name = e.target WHERE edge_type = 'imports' AND e.source <> s.namespace AND e.source IN (SELECT module FROM mods))
"""


@query("WITH " + MODULES + """, l AS (SELECT module, 0 AS section, '' AS key, 'Module `' || module || '` contains ' || symbols || ' symbols across ' || files || ' files.' AS line FROM mods
UNION ALL SELECT DISTINCT namespace, 1, file_path, '- `' || file_path || '`' FROM sym
UNION ALL SELECT namespace, 2, fq_name, '- **`' || fq_name || '`** (' || kind || '): `' || CASE WHEN signature <> '' THEN signature ELSE name END || '`' FROM sym WHERE kind IN ('class', 'interface', 'struct')
UNION ALL SELECT namespace, 3, fq_name, '- `' || signature || '`' FROM sym WHERE contains(mods, 'public') AND kind IN ('method', 'property')
UNION ALL SELECT namespace, 4, '', count(*) || ' internal members.' FROM sym WHERE NOT contains(mods, 'public') AND kind IN ('method', 'property', 'field') GROUP BY 1
UNION ALL SELECT module, 5, d, '- `' || d || '`' FROM mdep)
SELECT 'module' AS doc_type, module AS scope, section, (""" + _list(documents.MODULE_SECTIONS) + """)[section + 1] AS heading, key, line FROM l""")
def module_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.module_documents(starschema.graph(spark, sf_dir))


@query("""SELECT DISTINCT namespace AS scope, '[`' || fq_name || '`](' || file_path || '#L' || start_line || CASE WHEN kind IN ('class', 'interface', 'struct') AND end_line <> start_line THEN '-L' || end_line ELSE '' END || ')' AS line
FROM sym WHERE kind IN ('class', 'interface', 'struct') OR contains(mods, 'public') AND kind IN ('method', 'property')""")
def document_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.references(starschema.graph(spark, sf_dir))


README = """mods AS (SELECT namespace AS module, count(*) AS symbols, count(DISTINCT file_path) AS files FROM sym GROUP BY 1),
mdep AS (SELECT module, array_to_string(list_sort(list(d))[1:3], ', ') AS deps FROM (SELECT DISTINCT e.source AS module, s.namespace AS d FROM edge e JOIN sym s ON s.fq_name = e.target WHERE edge_type = 'imports' AND e.source <> s.namespace) GROUP BY 1),
kc AS (SELECT kind, count(*) AS n FROM sym GROUP BY 1), xc AS (SELECT regexp_extract(file_path, '([^.]*)$', 1) AS x, count(*) AS n FROM sym GROUP BY 1 ORDER BY n DESC, x LIMIT 5),
use AS (SELECT s.fq_name, end_line - start_line + 1 AS lines, coalesce(fan_in, 0) AS fi, coalesce(fan_out, 0) AS fo FROM sym s LEFT JOIN fin USING (fq_name) LEFT JOIN fout USING (fq_name)),
ux AS (SELECT *, '- `' || fq_name || '`: LOC=' || lines || ', fan-in=' || fi || ', fan-out=' || fo AS line FROM use),
l AS (SELECT 0 AS section, '' AS key, 'Codebase contains ' || (SELECT count(*) FROM sym) || ' symbols (' || (SELECT string_agg(n || ' ' || kind || '(s)', ', ' ORDER BY n DESC, kind) FROM kc) || '), ' || (SELECT count(*) FROM edge) || ' relationships, and ' || (SELECT count(*) FROM mods) || ' modules.' AS line
UNION ALL SELECT 1, lpad((row_number() OVER (ORDER BY n DESC, x))::VARCHAR, 6, '0'), '- **' || x || '**: ' || n || ' symbols' FROM xc
UNION ALL SELECT 2, module, '- **`' || module || '`** (' || symbols || ' symbols, ' || files || ' files)' || coalesce(' -> ' || deps, '') FROM mods LEFT JOIN mdep USING (module)
UNION ALL SELECT 3, fq_name, '- `' || fq_name || '` (interface)' FROM sym WHERE kind = 'interface'
UNION ALL SELECT * FROM (SELECT 4, lpad((row_number() OVER (ORDER BY fi DESC, lines DESC, fq_name))::VARCHAR, 6, '0') AS k, line FROM ux ORDER BY k LIMIT 10)
UNION ALL SELECT * FROM (SELECT 6, lpad((row_number() OVER (ORDER BY fi DESC, lines DESC, fq_name))::VARCHAR, 6, '0') AS k, line FROM ux WHERE fi >= 5 OR lines >= 50 ORDER BY k LIMIT 10)
UNION ALL SELECT * FROM (SELECT 7, lpad((row_number() OVER (ORDER BY name))::VARCHAR, 6, '0') AS k, '- `' || name || '`' FROM ext ORDER BY k LIMIT 20))
"""


@query("WITH " + FAN.strip().rstrip(",") + ", " + EXTERNAL + ", " + README + "SELECT 'readme' AS doc_type, '' AS scope, section, (" + _list(documents.README_SECTIONS) + ")[section + 1] AS heading, key, line FROM l")
def readme_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces stand for the entry points; no name of the tables is one of settings."""
    g = starschema.graph(spark, sf_dir)
    return documents.readme(g, g.symbols.filter("kind = 'interface'").select("fq_name", "kind"))


FLOW_EFFECTS = "|".join(documents.EFFECTS)


@query(f"""WITH cal AS (SELECT DISTINCT source AS a, target AS b FROM edge WHERE edge_type = 'calls'), ent AS (SELECT DISTINCT a AS entry FROM cal WHERE a NOT IN (SELECT b FROM cal) UNION SELECT fq_name FROM sym WHERE kind = 'constructor'),
walk AS (SELECT entry, entry AS node, 0 AS depth FROM ent UNION SELECT entry, b, depth + 1 FROM walk JOIN cal ON a = node WHERE depth < 10),
near AS (SELECT entry, node, min(depth) AS depth FROM walk GROUP BY 1, 2), st AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY depth, node) AS n FROM near QUALIFY n <= {documents.STEPS}),
l AS (SELECT entry AS scope, 0 AS section, '' AS key, 'Call flow starting from `' || entry || '`.' AS line FROM ent
  UNION ALL SELECT entry, 1, lpad(depth::VARCHAR, 4, '0') || ' ' || node, repeat('  ', depth) || '- `' || node || '` (' || coalesce(kind, '?') || ') [' || coalesce(file_path, '') || ']' FROM st LEFT JOIN sym ON fq_name = node
  UNION ALL SELECT b, 2, a, '- `' || a || '`' FROM cal WHERE b IN (SELECT entry FROM ent)
  UNION ALL SELECT entry, 3, lpad(depth::VARCHAR, 4, '0') || ' ' || node, '- `' || node || '` may perform I/O or mutations.' FROM st WHERE regexp_matches(lower(node), '{FLOW_EFFECTS}'))
SELECT 'flow' AS doc_type, scope, section, ({_list(documents.FLOW_SECTIONS)})[section + 1] AS heading, key, line FROM l""", recursive=True)
def flow_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of the calls from every symbol that calls but is not called, and of every constructor."""
    g = starschema.graph(spark, sf_dir)
    calls = g.of_type("calls")
    first = calls.select(F.col("source").alias("fq_name")).distinct().join(calls.select(F.col("target").alias("fq_name")), "fq_name", "left_anti")
    return documents.flow_documents(g, first.unionByName(g.symbols.filter("kind = 'constructor'").select("fq_name")))
