"""The registered queries of these operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchor_dedup, filter_audit, language_id, lexical_search, ngram_join, packing, piece_codec, pivot_search, quality_rules, secret_scan, suffix_dedup, token_counts, url_filters

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0).alias("bad"))
    return url_filters.judge(_table(spark, sf_dir, "pages"), outcomes, RULES)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_dedup.deduplicated(_table(spark, sf_dir, "documents"), texts=False)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(_table(spark, sf_dir, "documents"), texts=False)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    bits = F.col("failed_bits")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(bits, "base")).alias("base_failed"), quality_rules.passes(bits, "v2").alias("kept"), "failed_bits",
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identified(docs, language_id.fit(docs))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    named = [
        op1_url_filters, op2_ngram_join, op3_secret_scans, op4_best_fit_packing, op5_substring_dedup, op6_suffix_dedup, op7_sentencepiece, op8_exact_top_k, op9_token_counts, op10_quality_rules,
        op11_language_id, op12_lexical_search, op13_filter_audit,
    ]
    return {f.__name__: f for f in named}


def _rule_case(what: int) -> str:
    out = "NULL"
    for action, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        out = f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{action if what == 0 else host + path}' ELSE {out} END"
    return out


def _level(rate: str, source: str, mean: str, n: str, k: str) -> str:
    """SQL of one level's shrunken rates: the weight by moments, then the posterior mean."""
    return f"""(SELECT s.*, (weight * {mean} + {k}) / (weight + {n}) AS {rate}, weight + {n} AS {rate}_size FROM {source} s, (
        SELECT 1 / greatest(1.0 / 1001, least(0.5, coalesce(CASE WHEN sum({n} * ({n} - 1) * {mean} * (1 - {mean})) > 0
            THEN (sum(({k} - {n} * {mean}) * ({k} - {n} * {mean})) - sum({n} * {mean} * (1 - {mean}))) / sum({n} * ({n} - 1) * {mean} * (1 - {mean})) ELSE 1.0 END, 0.5))) - 1 AS weight
        FROM {source} WHERE {n} > 0) w)"""


def _above() -> str:
    """SQL of each host's share above the limit, in steps."""
    out, last = [], "by_host"
    for k, step in enumerate(url_filters.above_steps(url_filters.MAX_BAD, "list_sum(list_transform(range(0, {n} + 1), lambda i: {f}))")):
        out.append(f"share{k} AS (SELECT host, bad_rate, bad_rate_size, {', '.join(f'{e} AS {c}' for c, e in step.items())} FROM {last})")
        last = f"share{k}"
    return ", ".join(out) + f", shares AS (SELECT host, bad_rate, p_above FROM {last})"


SECOND = "|".join(url_filters.SECOND_LEVEL)
OP1_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
bad AS (SELECT doc_id AS page_id, count(*) AS labels, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
    WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1 OR (quality IS NOT NULL AND toxic IS NOT NULL)) GROUP BY doc_id),
labelled AS (SELECT host, sum(labels) AS n0, sum(bad) AS k0 FROM seen JOIN bad USING (page_id) GROUP BY host),
named AS (SELECT host, coalesce(n0, 0)::BIGINT AS n, coalesce(k0, 0)::BIGINT AS k,
    CASE WHEN regexp_matches(host, '(^|[.])({SECOND})[.][a-z][a-z]$') THEN regexp_extract(host, '(?:^|[.])((?:{SECOND})[.][a-z][a-z])$', 1) ELSE string_split(host, '.')[-1] END AS suffix
    FROM (SELECT DISTINCT host FROM seen) LEFT JOIN labelled USING (host)),
hosts AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - len(string_split(suffix, '.'))), len(string_split(host, '.'))), '.') AS domain FROM named),
domains AS (SELECT domain, min(suffix) AS suffix, sum(n)::BIGINT AS dn, sum(k)::BIGINT AS dk FROM hosts GROUP BY domain),
suffixes AS (SELECT suffix, sum(dn)::BIGINT AS sn, sum(dk)::BIGINT AS sk FROM domains GROUP BY suffix),
top AS (SELECT *, (SELECT (coalesce(sum(sk), 0) + 1) / (coalesce(sum(sn), 0) + 2) FROM suffixes) AS top FROM suffixes),
by_suffix AS (SELECT * FROM {_level("suffix_rate", "top", "top", "sn", "sk")}),
domain_in AS (SELECT d.*, suffix_rate FROM domains d JOIN by_suffix USING (suffix)),
by_domain AS (SELECT * FROM {_level("domain_rate", "domain_in", "suffix_rate", "dn", "dk")}),
host_in AS (SELECT h.*, domain_rate FROM hosts h JOIN by_domain USING (domain)),
by_host AS (SELECT host, bad_rate, bad_rate_size FROM {_level("bad_rate", "host_in", "domain_rate", "n", "k")}),
{_above()}
SELECT page_id, host, path, {_rule_case(1)} AS rule, coalesce({_rule_case(0)}, CASE WHEN p_above > {url_filters.LEVEL} THEN 'block' ELSE 'allow' END) AS verdict, round(bad_rate, 9) AS bad_rate, p_above
FROM seen JOIN shares USING (host)
"""


OP12_SQL = f"""
WITH term AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, '{url_filters.UPPER}', '{url_filters.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
posting AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf FROM term GROUP BY row, term),
lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM posting GROUP BY row),
size AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, size GROUP BY term),
asked AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, '{url_filters.UPPER}', '{url_filters.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
wanted AS (SELECT item, any_value(item_id) AS item_id, term, count(*)::BIGINT AS times FROM asked GROUP BY item, term),
scored AS (SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM wanted JOIN posting USING (term) JOIN weight USING (term) JOIN lengths USING (row), size GROUP BY item, row)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""

OP13_SQL = """
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
label AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
judged AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
        100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
    FROM words LEFT JOIN label USING (doc_id)),
failing AS (SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS failed, count(*)::BIGINT AS n FROM judged GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
ordered AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
    FROM letter p, letter q, letter r, letter s, letter t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
stepped AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM ordered, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN failed & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN failed & before <> 0 AND failed & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN failed = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
    FROM failing, stepped GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op12_lexical_search": OP12_SQL, "op13_filter_audit": OP13_SQL}
