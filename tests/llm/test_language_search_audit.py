"""Language identification, lexical search and filter audit against plain versions, with the awkward cases."""

import math
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import filter_audit, language_id, lexical_search, queries

AWKWARD = [
    (None, "no id here, the the THE", "en"),
    (None, "no id here, the the THE", "en"),
    (1, None, "en"),
    (2, "", None),
    (3, " \n\t ", "de"),
    (4, "ÉCOLE école Straße 漢字 a1b2", "fr"),
    (4, "ÉCOLE école Straße 漢字 a1b2", None),
    (5, "the " * 70_000, "en"),
    (6, "THE the AND and Zebra-zebra_x 42", "en"),
    (7, "12345 67 #$ ²½ --", "es"),
    (8, "x" * 100_000 + " the", "en"),
    (9, "\x00the\x7fand\x80end", ""),
    (-5, "the and of " * 90, "en"),
    (-5, "the and of " * 90, "en"),
    (10, "the and of " * 90, "fr"),
    (11, "SHOUT LOUD " + "word other thing " * 80, "de"),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string")
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id") * 3 + 100)
    return rows.unionByName(real).select("*", F.lit("clash").alias("part"), F.lit(1).alias("bits"), F.lit(None).cast("string").alias("payload"), F.lit(2.5).alias("score")).repartition(3, F.xxhash64("text", F.col("doc_id"))).cache()


# ---- op11 ----------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_language_id(spark, sf_dir).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert got.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) >= 0.95
    sure = [i for i in held if not got[i].rejected]
    assert len(sure) >= 0.8 * len(held) and np.mean([got[i].lang_pred == truth[i] for i in sure]) >= 0.97


def test_language_learns_from_what_it_may_only(spark, docs):
    allowed = docs.filter(~language_id.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    hidden = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")) | F.col("doc_id").isNull(), F.lit("zz")).otherwise(F.col("lang")))
    models = [language_id.fit(x, 64) for x in (docs, allowed, hidden, docs.repartition(5))]
    assert models[0].languages == sorted({r.lang for r in allowed.filter("text RLIKE '[a-zA-Zé]'").select("lang").distinct().collect()})
    for m in models[1:]:
        assert m.languages == models[0].languages and (m.rows == models[0].rows).all() and (m.weights == models[0].weights).all() and (m.temperature, m.floor) == (models[0].temperature, models[0].floor)
    found = [Counter(tuple(r) for r in language_id.identified(x, models[0]).collect()) for x in (docs, docs.withColumn("lang", F.lit("q")).withColumn("source", F.lit(1)).repartition(1))]
    assert found[0] == found[1]


def test_undetermined_language(spark, docs):
    got = [tuple(r) for r in language_id.identified(docs, language_id.fit(docs, 64)).join(docs.select("doc_id", F.col("text").alias("t")).distinct(), "doc_id").select("t", "lang_pred", "score").collect()]
    for t, lang, score in got:
        if t is None or not any(c.isalpha() for c in t):
            assert (lang, score) == ("und", 0)
        else:
            assert lang != "und" and score > 0
    assert any(t == AWKWARD[9][1] for t, _, _ in got)


def test_nothing_to_learn(spark, docs):
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.fit(blank) is None and language_id.fit(docs.limit(0)) is None
    assert {(r.lang_pred, r.score, r.rejected) for r in language_id.identified(blank, None).collect()} == {("und", 0.0, True)}
    assert language_id.identified(docs.limit(0), language_id.fit(docs, 64)).count() == 0
    one = language_id.fit(docs.withColumn("lang", F.lit("only")), 32)
    assert {r.lang_pred for r in language_id.identified(docs, one).collect()} == {"only", "und"}


def test_many_languages_share_the_sample(spark):
    rows = [(i, f"{'abcdefghijklmnopqrstuvwxyz'[i % 24] * 3}ary {'klmnoprstuvz'[i % 12]}o {i}", f"l{i % 24:02d}") for i in range(960)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.sample(docs, 240)) <= 240
    model = language_id.fit(docs, 480)
    assert len(model.languages) == 24 and model.table()[1] is not None  # more languages than DIM
    got = {r.doc_id: r.lang_pred for r in language_id.identified(docs, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.9


def test_subwords_of_one_text_do_not_depend_on_its_neighbours():
    texts = [t.encode() for _, t, _ in AWKWARD if t] + [b"\xff\xfe bad utf-8", "İstanbul".encode()]
    together = [sorted(np.concatenate([rows[cut[k] : cut[k + 1]] for rows, cut in language_id.subwords(texts)]).tolist()) for k in range(len(texts))]
    for k, t in enumerate(texts):
        assert sorted(np.concatenate([rows[cut[0] : cut[1]] for rows, cut in language_id.subwords([t])]).tolist()) == together[k]


def test_calibration_makes_scores_of_the_share_that_is_right():
    draw = np.random.default_rng(3)
    model = language_id.Model(["a", "b"])
    samples = []
    for _ in range(400):  # nine in ten are right, whatever the features say too loudly
        y = int(draw.integers(2))
        shown = y if draw.random() < 0.9 else 1 - y
        samples.append((np.array([shown]), np.array([1]), y))
    model.rows[:2] = np.eye(2, language_id.DIM) * 40
    model.weights = np.eye(language_id.DIM, 2)
    model.calibrate(samples)
    score = language_id._softmax(np.stack([model.logits(r, c) for r, c, _ in samples]) / model.temperature).max(1).mean()
    assert abs(score - 0.9) < 0.04 and model.floor > score - 1e-9


# ---- op12 ----------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k=20):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = Counter()
    for item, text in items:
        found = []
        for i, b, n in bags:
            m = 75 + (25 * n * n_docs) // n_terms
            score = 0
            for t, times in Counter(terms_of(text)).items():
                if b[t]:
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 12 * m))
            if score > 0:
                found.append((-score, i is not None, i))
        for rank, (score, _, i) in enumerate(sorted(found)[:k], 1):
            out[item, rank, i, -score] += 1
    return out


ITEMS = [(1, "the école zebra"), (1, "the école zebra"), (1, "and of of OF"), (None, "漢字 a1b2 42"), (2, None), (3, ""), (4, "--"), (5, "absentterm"), (6, "straße Straße STRASSE x end word thing " * 50)]


@pytest.mark.parametrize("window", [4096, 3])
def test_search(spark, docs, sf_dir, window, monkeypatch):
    monkeypatch.setattr(lexical_search, "WINDOW", window)
    if window == 3:  # small bounds everywhere: blocks, windows and texts are cut, and bits shared
        for name, value in (("BLOCK", 64), ("POSTINGS", 40), ("TEXT", 5000), ("BITS", 256)):
            monkeypatch.setattr(lexical_search, name, value)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").unionByName(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").limit(12)).withColumn("payload", F.lit(0))
    got = Counter(tuple(r) for r in lexical_search.search(docs, items).select("item_id", "rank", "doc_id", "score").collect())
    assert got == plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_search_without_rows(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit(None).cast("string")), items), (docs, items.filter("item_id = 4"))):
        assert lexical_search.search(d, i).count() == 0


def test_search_equals_sql(spark, sf_dir):
    want = over_sql("op12_lexical_search", sf_dir, ("item_id", "rank", "doc_id", "score"))
    assert Counter(tuple(r) for r in queries.op12_lexical_search(spark, sf_dir).select("item_id", "rank", "doc_id", "score").collect()) == want


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**9, 10**12])
    assert lexical_search.lengths_measure(n, 10**11, 10**14).tolist() == [75 + 25 * x * 10**11 // 10**14 for x in n.tolist()]


def test_occurrences_beyond_32_bits_are_kept():
    parts = [np.array(x) for x in ([7], [9])], np.array([5], dtype="<u8"), np.array([1]), np.array([0])
    for times in (3, 2**40):
        assert lexical_search._unpacked(lexical_search._packed(*parts[0], *parts[1:], np.array([times])))[5].tolist() == [times]


# ---- op13 ----------------------------------------------------------------------------------

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def over_sql(name, sf_dir, columns):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return Counter(con.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall())


def plain_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    seen = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t])) if x}
        seen.append((part or "", fails, i is not None and i in good, i is not None and i in toxic))
    rows, shapley = [], Counter()
    for order in permutations("ABCDE"):
        for part in {p for p, *_ in seen}:
            mine = [s for s in seen if s[0] == part]
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [s for s in mine if f in s[1] and not s[1] & before]
                kept = sum(not s[1] & (before | {f}) for s in mine)
                rows.append((part, "".join(order), k + 1, kept, len(gone), sum(f in s[1] for s in mine) - len(gone), sum(s[1] == {f} for s in mine), sum(s[2] for s in gone), sum(s[3] for s in gone)))
                shapley[part, f] += len(gone)
    return Counter((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def test_audit(spark, docs):
    few = docs.filter("doc_id IS NULL OR doc_id < 400")
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, None, 1), (None, 1, 1), (10, 1, None), (-5, 1, 0), (103, 1, 1), (106, 1, 0), (999999, 1, 1)], "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = Counter(tuple(r) for r in filter_audit.audit(few, labels).select(*COLUMNS).collect())
    assert got == plain_audit([(r.doc_id, r.text, r.lang) for r in few.collect()], [tuple(r)[:3] for r in labels.collect()])
    assert filter_audit.audit(few.limit(0), labels).count() == 0
    assert filter_audit.audit(few, labels.limit(0)).count() == len({p for p, *_ in got}) * 600


def test_audit_equals_sql(spark, sf_dir):
    assert Counter(tuple(r) for r in queries.op13_filter_audit(spark, sf_dir).select(*COLUMNS).collect()) == over_sql("op13_filter_audit", sf_dir, COLUMNS)
