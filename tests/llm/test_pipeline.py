"""The pipeline against plain versions of its stages, each on its own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import in_order
from tests.llm.test_ngram_join import plain
from tests.llm.test_text_operators import quality
from weftgraph.llm import queries, quality_rules, secret_scan


def kept_bytes(rows, size=100):
    out, seen = [], set()
    for i, text in in_order(rows):
        b = text.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            if w in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(w)
        out.append((i, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    return out


def test_run(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mask = quality_rules.mask_of("v2")
    bits = {r.doc_id: r.failed_bits for r in quality_rules.ledger(docs).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if not bits[r.doc_id] & mask]
    assert all(not quality(t)[-1] for _, t in rows)
    first = {c for _, _, c in plain(rows, 5, 80)}
    rows = kept_bytes([r for r in rows if r[0] in first])
    clean = []
    for i, t in rows:
        spans = sorted((s, e) for s, _, e in secret_scan.spans_of(t, 8.0)[1])
        merged, at = "", 0
        for s, e in spans:
            if s >= at:
                merged += t[at:s] + "[SECRET]"
            at = max(at, e)
        clean.append((i, merged + t[at:]))
    assert not any(re.search(r"[0-9a-f]{32}", t) for _, t in clean)
    library = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    want = Counter()
    for i, t in clean:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[(i, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], dtype="<u4").tobytes()))] += 1
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(tuple(r)[:5] for r in got) == want


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "xx", "s", 0), (5, "token = abcdefgh1234 " + "word " * 70, "xx", "s", 9)], docs.schema)
    docs = docs.filter("doc_id < 40").unionByName(odd)
    clashing = ["_later", "later", "row", "ledger", "block", "key", "s", "c0"]
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(clashing)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert all(r.text is None or r.n_chars == len(r.text) for r in rows if r.n_chars != 9 and name in ("suffix-array dedup", "secret scans"))
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "Etc/UTC", "America/New_York"])
def test_stages_keep_columns_of_any_type(spark, sf_dir, tmp_path, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 30")
        odd = docs.selectExpr(
            "*", "timestamp_seconds(doc_id) AS at", "timestamp_ntz '2024-01-01 00:00:00' AS ntz", "date '2024-02-03' AS day", "array(1, 2) AS whole", "array(timestamp_seconds(5), null) AS times",
            "named_struct('a b', doc_id, 'c.d', timestamp_seconds(doc_id), 'e`f', array('x')) AS odd", "map('k', named_struct('t', timestamp_seconds(1))) AS m", "map('k', 1) AS `m 2`", "cast(1.5 AS decimal(9,2)) AS dec",
            "X'00ff' AS raw", "interval '1' day AS span", "cast(null AS double) AS nothing", "true AS `yes.no`", "cast(3 AS tinyint) AS tiny",
        )
        odd.write.parquet(str(tmp_path / "odd"))
        for frame in (odd, spark.read.parquet(str(tmp_path / "odd"))):
            for name, stage in corpus_pipeline.STAGES[:-1]:
                out = stage(spark, frame, sf_dir)
                assert out.dtypes == frame.dtypes, name
                extra = [f"`{c}`" for c in frame.columns if c not in ("text", "n_chars")]
                want = {r.doc_id: r for r in frame.select(*extra).collect()}
                got = out.select(*extra).collect()
                assert got and all(r == want[r.doc_id] for r in got), name
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
