"""A code graph derived from a star schema: suppliers are types, parts their members, orders call chains.

`graph(spark, dir)` builds it with DataFrames; `PRELUDE` derives the same tables as SQL views
for an oracle. Symbols, inheritance, dependencies and blame use every row of their tables. What a
call or an import is, is part of the binding: steps of orders that are 1-URGENT and F (backward
ones where the order key is a multiple of 97), and returned lines of quantity 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import CodeGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("."), F.lower("n_name")).alias("ns"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(nation, "s_nationkey")


def _count(df: DataFrame) -> DataFrame:
    return F.broadcast(df.agg(F.count("*").alias("n")))  # one row


def _path(ns, key) -> F.Column:
    return F.concat(F.replace(ns, F.lit("."), F.lit("/")), F.lit("/s"), key.cast("string"), F.lit(".py"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _suppliers(spark, sf_dir)
    k = F.col("s_suppkey")
    types = s.select(
        F.concat("ns", F.lit(".S"), k.cast("string")).alias("fq_name"), F.concat(F.lit("S"), k.cast("string")).alias("name"),
        F.when(k % 5 == 0, "interface").when(k % 5 == 1, "struct").otherwise("class").alias("kind"), _path(F.col("ns"), k).alias("file_path"), F.col("ns").alias("namespace"),
        F.lit(None).cast("string").alias("parent_fq_name"), F.lit(1).alias("start_line"), (1 + (37 * k) % 600).cast("int").alias("end_line"), F.lit("").alias("signature"),
        F.filter(F.array(F.when(k % 3 == 0, "public"), F.when(k % 7 == 0, "abstract")), lambda x: x.isNotNull()).alias("modifiers"),
        F.lit(0).alias("n_params"), F.lit("").alias("return_type"), F.when(k % 2 == 0, "").otherwise("doc").alias("doc_comment"),
        F.lit(0).alias("cyclomatic_complexity"), F.lit(0).alias("cognitive_complexity"), F.lit("").alias("structural_fingerprint"),
    )
    p = table(spark, sf_dir, "part").crossJoin(_count(table(spark, sf_dir, "supplier"))).withColumn("s_suppkey", F.col("p_partkey") % F.col("n"))
    m = p.join(s, "s_suppkey")
    key, size = F.col("p_partkey"), F.col("p_size")
    start = 10 + 50 * F.floor(key / F.col("n"))
    words = F.split("p_name", " ")
    parent = F.concat("ns", F.lit(".S"), k.cast("string"))
    name = F.when(key % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).when(key % 3 == 1, F.concat(words[0], F.initcap(F.coalesce(F.try_element_at(words, F.lit(2)), F.lit(""))))).otherwise(F.concat(F.lit("p"), key.cast("string")))
    kind = F.when(size % 10 == 0, "constructor").when((size % 10).isin(1, 2), "field").when(size % 10 == 3, "property").otherwise("method")
    members = m.select(
        F.concat(parent, F.lit(".p"), key.cast("string")).alias("fq_name"), name.alias("name"), kind.alias("kind"), _path(F.col("ns"), k).alias("file_path"), F.col("ns").alias("namespace"),
        parent.alias("parent_fq_name"), start.cast("int").alias("start_line"), (start + size - 1).cast("int").alias("end_line"), F.concat(F.lit("def "), F.col("p_name")).alias("signature"),
        F.filter(F.array(F.when(key % 11 == 0, "public"), F.when(key % 5 == 0, "static")), lambda x: x.isNotNull()).alias("modifiers"),
        (key % 9).cast("int").alias("n_params"), F.when(F.col("p_type") == F.lit("PROMO"), "void").when(F.col("p_type") == F.lit("STANDARD"), "bool").otherwise(F.lower("p_type")).alias("return_type"),
        F.when(key % 4 == 0, "").otherwise("doc").alias("doc_comment"),
        (1 + F.floor("p_retailprice") % 40).cast("int").alias("cyclomatic_complexity"), (F.floor(7 * F.col("p_retailprice")) % 60).cast("int").alias("cognitive_complexity"),
        F.substring(F.md5(F.concat("p_type", F.lit("/"), size.cast("string"), F.lit("/"), F.col("p_brand")).cast("binary")), 1, 16).alias("structural_fingerprint"),
    )
    both = types.unionByName(members).withColumn("parameters", F.expr("transform(sequence(1, n_params + 1), x -> 'p')")).withColumn("parameters", F.slice("parameters", F.lit(1), F.col("n_params")))
    return both.drop("n_params")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _suppliers(spark, sf_dir).withColumn("fq", F.concat("ns", F.lit(".S"), F.col("s_suppkey").cast("string")))
    n = _count(table(spark, sf_dir, "supplier"))
    line = F.lit(0).alias("line")
    member = (
        table(spark, sf_dir, "part").select("p_partkey", "p_size").crossJoin(n).withColumn("s_suppkey", F.col("p_partkey") % F.col("n")).join(s, "s_suppkey")
        .select("p_partkey", "p_size", "s_nationkey", "ns", "s_suppkey", F.col("fq").alias("type_fq"), F.concat("fq", F.lit(".p"), F.col("p_partkey").cast("string")).alias("fq"))
    )
    contains = member.select(F.col("type_fq").alias("source"), F.col("fq").alias("target"), F.lit("contains").alias("edge_type"), _path(F.col("ns"), F.col("s_suppkey")).alias("file_path"), line)
    urgent = table(spark, sf_dir, "orders").filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).select(F.col("o_orderkey").alias("l_orderkey"))
    chain = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(urgent, "l_orderkey")
    steps = lines.withColumn("next", F.lead("l_partkey").over(chain)).filter("next is not null").select("l_orderkey", F.col("l_partkey").alias("a"), F.col("next").alias("b"))
    from_ = member.filter((F.col("p_size") % 10 == 0) | (F.col("p_size") % 10 > 3)).select(F.col("p_partkey").alias("a"), F.col("fq").alias("source"), F.col("s_nationkey").alias("na"), _path(F.col("ns"), F.col("s_suppkey")).alias("file_path"))
    to = member.select(F.col("p_partkey").alias("b"), F.col("fq").alias("target"), F.col("s_nationkey").alias("nb"))
    calls = (
        steps.join(from_, "a").join(to, "b").filter((F.col("na") <= F.col("nb")) | (F.col("l_orderkey") % 97 == 0))
        .select("source", "target", F.lit("calls").alias("edge_type"), "file_path").distinct().withColumn("line", F.lit(0))
    )
    base = s.select(F.col("s_suppkey").alias("base"), F.col("fq").alias("target"))
    inherits = s.filter("s_suppkey > 0").withColumn("base", F.floor(F.col("s_suppkey") / 3)).join(base, "base").select(F.col("fq").alias("source"), "target", F.lit("inherits").alias("edge_type"), _path(F.col("ns"), F.col("s_suppkey")).alias("file_path"), line)
    implements = (
        s.filter("s_suppkey % 5 > 1").crossJoin(n).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("s_suppkey") % 5))).withColumn("base", (5 * (F.col("s_suppkey") + F.col("k"))) % F.col("n"))
        .join(base, "base").select(F.col("fq").alias("source"), "target", F.lit("implements").alias("edge_type"), _path(F.col("ns"), F.col("s_suppkey")).alias("file_path"), line)
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("."), F.lower("n_name")).alias("cns"))
    buyers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "cns")
    returned = table(spark, sf_dir, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") == 50)).select("l_orderkey", "l_suppkey")
    imports = (
        returned.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(buyers, "o_custkey").join(s.select(F.col("s_suppkey").alias("l_suppkey"), "fq"), "l_suppkey")
        .select(F.col("cns").alias("source"), F.col("fq").alias("target"), F.lit("imports").alias("edge_type"), F.concat(F.replace("cns", F.lit("."), F.lit("/")), F.lit("/imports.py")).alias("file_path")).distinct().withColumn("line", F.lit(0))
    )
    return contains.unionByName(calls).unionByName(inherits).unionByName(implements).unionByName(imports)


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.element_at(F.array(*[F.lit(v) for v in ("*", "latest", ">=1.0", "==1.2", ">=1,<2", "^1.0")]), (F.col("p_size") % 6 + 1).cast("int"))
    p = table(spark, sf_dir, "part")
    pinned = F.col("version").rlike(r"[><=^~*|]|^latest$|^$")
    return p.select(
        F.lower("p_brand").alias("name"), version.alias("version"), F.element_at(F.array(F.lit("pypi"), F.lit("npm"), F.lit("maven")), (F.col("p_partkey") / 10 % 3 + 1).cast("int")).alias("ecosystem"),
        F.concat(F.lit("manifests/m"), (F.col("p_partkey") % 7).cast("string")).alias("file_path"), (F.col("p_partkey") % 4 == 0).alias("is_dev"),
    ).withColumn("is_pinned", ~pinned)


def blame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, line_no, author, committed_at, commit) of events."""
    s = _suppliers(spark, sf_dir).select("s_suppkey", _path(F.col("ns"), F.col("s_suppkey")).alias("file_path"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts").crossJoin(_count(table(spark, sf_dir, "supplier")))
    e = e.withColumn("s_suppkey", F.col("event_id") % F.col("n")).join(s, "s_suppkey")
    return e.select("file_path", F.floor(F.col("event_id") / F.col("n")).cast("int").alias("line_no"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), F.col("ts").alias("committed_at"), F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 12).alias("commit"))


def graph(spark: SparkSession, sf_dir: str, blame: bool = False) -> CodeGraph:
    """The code graph; with `blame`, symbols carry what the blame join found."""
    from ..operators.blame import by_symbol

    s = symbols(spark, sf_dir)
    if blame:
        found = by_symbol(s, blame_lines(spark, sf_dir)).select("fq_name", F.col("commit_count").cast("int"), F.col("author_count").cast("int"), "last_author", "last_modified_at")
        s = s.join(found, "fq_name", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("commit_count", "author_count")}).withColumn("last_author", F.coalesce("last_author", F.lit("")))
    return CodeGraph(s, edges(spark, sf_dir), dependencies(spark, sf_dir))


#: The same tables for an oracle in SQL; modifiers are a comma-separated string there.
PRELUDE = """
nsup AS (SELECT count(*) AS n FROM supplier),
sup AS (SELECT s_suppkey AS k, s_nationkey AS nk, 'r' || n_regionkey || '.' || lower(n_name) AS ns FROM supplier JOIN nation ON s_nationkey = n_nationkey),
styp AS (SELECT *, ns || '.S' || k AS fq, replace(ns, '.', '/') || '/s' || k || '.py' AS path FROM sup),
mem AS (SELECT p.*, t.*, t.fq || '.p' || p_partkey AS mfq, 10 + 50 * (p_partkey // (SELECT n FROM nsup)) AS st FROM part p JOIN styp t ON t.k = p_partkey % (SELECT n FROM nsup)),
sym AS (
  SELECT fq AS fq_name, 'S' || k AS name, CASE k % 5 WHEN 0 THEN 'interface' WHEN 1 THEN 'struct' ELSE 'class' END AS kind, path AS file_path, ns AS namespace, NULL::VARCHAR AS parent,
    1::INT AS start_line, (1 + (37 * k) % 600)::INT AS end_line, '' AS signature, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'public' END, CASE WHEN k % 7 = 0 THEN 'abstract' END) AS mods, 0::INT AS n_params, '' AS return_type,
    CASE WHEN k % 2 = 0 THEN '' ELSE 'doc' END AS doc_comment, 0::INT AS cc, 0::INT AS cog, '' AS fp FROM styp
  UNION ALL
  SELECT mfq, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || lower(substr(split_part(p_name, ' ', 2), 2)) ELSE 'p' || p_partkey END,
    CASE WHEN p_size % 10 = 0 THEN 'constructor' WHEN p_size % 10 IN (1, 2) THEN 'field' WHEN p_size % 10 = 3 THEN 'property' ELSE 'method' END, path, ns, fq, st::INT, (st + p_size - 1)::INT, 'def ' || p_name,
    concat_ws(',', CASE WHEN p_partkey % 11 = 0 THEN 'public' END, CASE WHEN p_partkey % 5 = 0 THEN 'static' END), (p_partkey % 9)::INT,
    CASE p_type WHEN 'PROMO' THEN 'void' WHEN 'STANDARD' THEN 'bool' ELSE lower(p_type) END, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'doc' END, (1 + floor(p_retailprice)::BIGINT % 40)::INT, (floor(7 * p_retailprice)::BIGINT % 60)::INT,
    substr(md5(p_type || '/' || p_size || '/' || p_brand), 1, 16) FROM mem),
callstep AS (SELECT l_orderkey AS o, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'),
edge AS (
  SELECT fq AS source, mfq AS target, 'contains' AS edge_type, path AS file_path FROM mem
  UNION ALL SELECT DISTINCT x.mfq, y.mfq, 'calls', x.path FROM callstep JOIN mem x ON x.p_partkey = a JOIN mem y ON y.p_partkey = b
    WHERE (x.p_size % 10 = 0 OR x.p_size % 10 > 3) AND (x.nk <= y.nk OR o % 97 = 0)
  UNION ALL SELECT s.fq, b.fq, 'inherits', s.path FROM styp s JOIN styp b ON b.k = s.k // 3 WHERE s.k > 0
  UNION ALL SELECT s.fq, b.fq, 'implements', s.path FROM styp s, range(1, 5) r(i), styp b WHERE s.k % 5 > 1 AND i <= s.k % 5 AND b.k = (5 * (s.k + i)) % (SELECT n FROM nsup)
  UNION ALL SELECT DISTINCT 'r' || n_regionkey || '.' || lower(n_name), t.fq, 'imports', replace('r' || n_regionkey || '.' || lower(n_name), '.', '/') || '/imports.py'
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN styp t ON t.k = l_suppkey WHERE l_returnflag = 'R' AND l_quantity = 50),
dep AS (SELECT lower(p_brand) AS name, (['*', 'latest', '>=1.0', '==1.2', '>=1,<2', '^1.0'])[p_size % 6 + 1] AS version, (['pypi', 'npm', 'maven'])[(p_partkey // 10) % 3 + 1] AS ecosystem,
  'manifests/m' || (p_partkey % 7) AS file_path, p_partkey % 4 = 0 AS is_dev FROM part),
blame AS (SELECT path AS file_path, (event_id // (SELECT n FROM nsup))::INT AS line_no, 'u' || user_id AS author, ts AS committed_at, substr(md5(event_id::VARCHAR), 1, 12) AS commit
  FROM events JOIN styp ON k = event_id % (SELECT n FROM nsup))
"""
