"""Window removal against brute force: words (anchors) and bytes (suffix arrays)."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_ngram_join import twins
from weftgraph.llm import anchor_dedup, suffix_dedup


def corpus(seed, n=70):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéß漢", k=rng.randint(1, 7))) for _ in range(400)]
    passages = [" ".join(rng.choices(words, k=rng.randint(15, 60))) for _ in range(6)]
    rows = []
    for k in range(n):
        kind = rng.randint(0, 6)
        if kind == 0 and rows:
            text = rng.choice(rows)[1]
        elif kind == 1 and rows:
            parts = (rng.choice(rows)[1] or "").split(" ")
            if parts:
                parts[rng.randrange(len(parts))] = "edit"
            text = " ".join(parts)
        elif kind == 2:
            text = " ".join(rng.choices(words, k=rng.randint(0, 50))) + rng.choice([" ", "\n", "\t\t"]) + rng.choice(passages) + " " + " ".join(rng.choices(words, k=rng.randint(0, 30)))
        elif kind == 3:
            text = rng.choice(["x", "ab ", "same words ", "é"]) * rng.randint(1, 300)
        else:
            text = " ".join(rng.choices(words, k=rng.randint(0, 120)))
        rows.append((k * 7 % n, text))
    rows += [(None, rows[0][1]), (None, "no id " * 40), (3, rows[5][1]), (3, rows[5][1]), (900, None), (901, ""), (902, " \n "), (903, "z" * 5000), (904, "z" * 250 + " " + "y" * 99 + "z" * 130)]
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], (r[1] or "").encode()))


def plain_words(rows, size):
    out, seen = [], set()
    for i, text in in_order(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        removed = set()
        for k in range(len(words) - size + 1):
            w = tuple(words[k : k + size])
            if w in seen:
                removed |= set(range(k, k + size))
            seen.add(w)
        kept = " ".join(w for k, w in enumerate(words) if k not in removed)
        out.append((i, len(words), len(removed), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def plain_bytes(rows, size):
    out, seen = [], set()
    for i, text in in_order(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            if w in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("block"), F.lit(1).alias("key"), F.lit(2).alias("n_words")).repartition(5)


@pytest.mark.parametrize("seed,blocks", [(1, None), (2, 1), (3, 40)])
def test_words(spark, seed, blocks):
    rows = corpus(seed)
    got = anchor_dedup.deduplicated(frame(spark, rows), blocks=blocks)
    assert Counter(tuple(r)[:4] for r in got.collect()) == plain_words(rows, 20)


@pytest.mark.parametrize("seed,blocks", [(1, None), (2, 1), (3, 40)])
def test_bytes(spark, seed, blocks):
    rows = corpus(seed)
    got = suffix_dedup.deduplicated(frame(spark, rows), blocks=blocks)
    assert Counter(tuple(r)[:5] for r in got.collect()) == plain_bytes(rows, 100)


@pytest.mark.parametrize("part", [1, 700])
def test_bytes_in_small_parts(spark, monkeypatch, part):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    rows = corpus(4)
    assert Counter(tuple(r)[:5] for r in suffix_dedup.deduplicated(frame(spark, rows)).collect()) == plain_bytes(rows, 100)


def test_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in anchor_dedup.deduplicated(docs, texts=False).collect()) == plain_words(rows, 20)
    assert Counter(tuple(r) for r in suffix_dedup.deduplicated(docs, texts=False).collect()) == plain_bytes(rows, 100)


def test_cover_has_every_difference():
    p, c = anchor_dedup.PERIOD, anchor_dedup.COVER
    assert {(a - b) % p for a in c for b in c} == set(range(p))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert anchor_dedup.deduplicated(none).count() == suffix_dedup.deduplicated(none).count() == 0


def test_contexts_of_one_key_are_sorted_apart(monkeypatch):
    rng = np.random.default_rng(5)
    gram = bytes(range(97, 113))
    texts = [rng.integers(97, 123, 84, dtype=np.uint8).tobytes() + gram + rng.integers(97, 123, 84, dtype=np.uint8).tobytes() for _ in range(300)]
    texts += [texts[k][20:150] + b"#" * 30 for k in range(0, 300, 3)] + [texts[7] + b"%" + texts[7]]

    def lost():
        n = len(texts)
        payload = suffix_dedup._packed(np.full(n, 7, "<u8"), np.arange(n, dtype="<i8"), np.arange(n, dtype="<i4"), texts)
        out = suffix_dedup._sort_shard(pa.table({"bucket": pa.array([0], pa.int32()), "block": pa.array([0], pa.int32()), "payload": pa.array([payload], pa.binary())}))
        rows = np.concatenate([np.frombuffer(x, suffix_dedup.RANGE) for x in out.column("payload").to_pylist()])
        return {(int(r["serial"]), at) for r in rows for at in range(r["begin"], r["end"])}

    seen, want = set(), set()
    for k, text in enumerate(texts):
        for at in range(len(text) - suffix_dedup.LENGTH + 1):
            window = text[at : at + suffix_dedup.LENGTH]
            want |= {(k, at)} if window in seen else set()
            seen.add(window)
    assert want and lost() == want
    sizes, sort = [], suffix_dedup._lost_windows
    monkeypatch.setattr(suffix_dedup, "PART", 4000)
    monkeypatch.setattr(suffix_dedup, "_lost_windows", lambda strings: sizes.append(sum(map(len, strings))) or sort(strings))
    assert lost() == want
    assert max(sizes) <= 4500 < sum(map(len, texts))


def test_unlike_strings_and_long_texts(spark):
    x, y = twins()
    rng = random.Random(5)
    same = " ".join(f"v{k}" for k in range(19))
    long = " ".join(rng.choices([f"w{k}" for k in range(3000)], k=60000))
    rows = [(1, f"{x} {same}"), (2, f"{y} {same}"), (3, " ".join(x)), (4, " ".join(y)), (5, long), (6, "a " + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("block"), F.lit(1).alias("key"))
    assert Counter(tuple(r) for r in anchor_dedup.deduplicated(df, texts=False).collect()) == plain_words(rows, 20)
    assert Counter(tuple(r) for r in suffix_dedup.deduplicated(df, texts=False).collect()) == plain_bytes(rows, 100)


@pytest.mark.parametrize("operator", [anchor_dedup, suffix_dedup])
def test_small_tables_are_dealt_to_few_blocks(spark, monkeypatch, operator):
    """Buckets answer every block, so the blocks of a small table must not follow the partitions."""
    seen, deal = [], operator.in_blocks
    monkeypatch.setattr(operator, "in_blocks", lambda docs, columns, blocks: seen.append(blocks) or deal(docs, columns, blocks))
    rows, old = corpus(5), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        got = Counter(tuple(r)[:4] for r in operator.deduplicated(frame(spark, rows), texts=False).drop("n_spans").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    plain = plain_words(rows, 20) if operator is anchor_dedup else Counter((a, b, c, e) for (a, b, c, _, e), n in plain_bytes(rows, 100).items() for _ in range(n))
    assert got == plain
    assert seen == [1]
