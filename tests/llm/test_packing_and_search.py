"""Packing and exact search against sequential and brute-force versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import packing, pivot_search, queries

TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "it's  don't\tWE'LL\r\n x1y22 é́ İstanbul ΣΑΣ \x85\xa0\x1c a b"), (5, "<|endoftext|> a<|startoftext|>b"), (6, "word " * 9000), (7, "x" * 9000), (7, "x" * 9000), (None, "no id"), (8, "漢字 😀 ́a")]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    odd = spark.createDataFrame(TEXTS, "doc_id long, text string")
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    return odd.unionByName(real).select("*", F.lit(0).alias("length"), F.lit("x").alias("salt")).repartition(4)


def test_pieces_and_places(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(r.doc_id, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))] += 1
    got = packing.packed(docs, path).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 2048) * 1.03 + 1


def sequential(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


def test_rounds_equal_sequential_best_fit():
    rng = random.Random(3)
    for capacity in (7, 20, 64):
        for _ in range(40):
            lengths = [rng.randint(1, rng.choice([3, capacity])) if capacity > 3 else 1 for _ in range(rng.randint(0, 200))]
            plan = packing.best_fit(Counter(lengths), capacity)
            used = Counter()
            for length, lo, hi, each, first, offset in plan:
                for rank in range(lo, hi):
                    used[first + (rank - lo) // each] += length
            assert sorted(capacity - n for n in used.values()) == sequential(lengths, capacity)
            ranks = defaultdict(list)
            for length, lo, hi, *_ in plan:
                ranks[length] += range(lo, hi)
            assert all(sorted(r) == list(range(Counter(lengths)[length])) for length, r in ranks.items())


def plain_search(rows, k=10):
    good = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and None not in v and all(np.isfinite(v))]
    out = Counter()
    for q in {i for i, _ in good if i % 100 == 0}:
        mine = next(v for i, v in good if i == q)
        best = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in good if i != q)[:k]
        for rank, (s, i) in enumerate(best, 1):
            out[(q, rank, i, -s)] += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, sf_dir, monkeypatch, small):
    if small:
        monkeypatch.setattr(pivot_search, "SLICE", 7)
        monkeypatch.setattr(pivot_search, "PIVOTS", 5)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(4, 6))
    rows = [(int(i), (centre[i % 4] + rng.normal(size=6) * 0.2).astype(np.float32).tolist()) for i in rng.permutation(700)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]  # one vector many times: ties
    rows += [(2000, None), (2100, []), (2200, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2300, [float("nan")] * 6), (2400, [float("inf")] * 6), (None, [1.0] * 6), (2500, [0.0] * 6), (3, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1)).repartition(5)
    got = Counter(tuple(r) for r in pivot_search.top_k(df, lambda v: v % 100 == 0).collect())
    assert got == plain_search(rows)


def test_search_real(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert Counter(tuple(r) for r in pivot_search.top_k(df, lambda v: v % 100 == 0).collect()) == plain_search(rows)


def test_few_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (5, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in pivot_search.top_k(few, lambda v: v % 100 == 0).collect()] == [(0, 1, 1, 4 * 1024 * 1024)]
    assert pivot_search.top_k(few.limit(0), lambda v: v % 100 == 0).count() == 0
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer("word_bpe_49k.json")).count() == 0


def test_search_of_several_dimensions(spark):
    rng = np.random.default_rng(2)
    sets = {6: range(0, 300), 4: range(300, 420), 1: range(420, 500), 0: range(500, 520)}
    rows = {n: [(i, rng.normal(size=n).astype(np.float32).tolist()) for i in ids] for n, ids in sets.items()}
    df = spark.createDataFrame([r for part in rows.values() for r in part], "vec_id long, embedding array<float>").repartition(3)
    want = sum((plain_search(rows[n]) for n in (6, 4)), Counter())
    want += Counter((500, k + 1, 501 + k, 0) for k in range(10))  # vectors of no component: ties
    assert Counter(tuple(r) for r in pivot_search.top_k(df, lambda v: v % 100 == 0).collect()) == want


def test_tasks_of_a_worker_share_words():
    """The next task of a worker splits only words that the last one did not, and all ids stay the library's."""
    tokenizer = packing.WordTokenizer(queries.tokenizer("word_bpe_49k.json"))
    split, merges = [], tokenizer.merges

    class Counting:
        def encode(self, text, **more):
            split.append(text.split(" "))
            return merges.encode(text, **more)

    tokenizer.merges = Counting()
    texts = ["It's they'll 'tis x'd 'Ve 12 3.5 n\u01b5o \u0130stanbul caf\xe9 -- don't_stop", "plain words again", "'s'st're 'm"]
    expected = [np.array(tokenizer.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert tokenizer.ids([t.encode() for t in texts]) == expected
    tokenizer.rest()
    split.clear()
    assert tokenizer.ids([(t + " newword").encode() for t in texts[1:2]] + [texts[0].encode()])[1] == expected[0]
    assert [sorted(w) for w in split] == [["newword"]]
