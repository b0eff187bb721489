"""The n-gram join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import blocks, ngram_join


def grams(text, n=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return set()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)}


def plain(rows, n=3, percent=90):
    sets = [(i, grams(t, n)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                ri, rj = sorted((root(i), root(j)))
                up[rj] = ri
    return Counter((i, len(a), root(i)) for i, a in sets)


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 6))) for _ in range(300)]
    passage = rng.choices(words, k=40)
    base = rng.choices(words, k=60)
    rows = []
    for k in range(n):
        kind = rng.randint(0, 5)
        if kind == 0 and rows:
            text = rng.choice(rows)[1].upper() if rng.random() < 0.3 else rng.choice(rows)[1]
        elif kind == 1 and rows:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        elif kind == 2:
            text = " ".join(passage + rng.choices(words, k=rng.randint(0, 40)))
        elif kind == 3:
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 9))
            text = "\t".join(w)
        else:
            text = " ".join(rng.choices(words, k=rng.randint(0, 30)))
        rows.append(((k * 37) % n, text))
    return [*rows, (1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "a b a b a b a b a b a b"), (3, rows[9][1]), (3, rows[9][1]), (None, rows[9][1]), (1007, "w " * 30000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("cluster"), F.lit("x").alias("root"), F.lit(0).alias("weight")).repartition(6)


@pytest.mark.parametrize("seed,chunk", [(1, ngram_join.CHUNK), (2, 400), (3, 2000)])
def test_classes(spark, seed, chunk):
    rows = corpus(seed)
    got = Counter(tuple(r) for r in ngram_join.classes(frame(spark, rows), chunk=chunk).collect())
    assert got == plain(rows)


def test_other_settings(spark):
    rows = corpus(5, 80)
    got = Counter(tuple(r) for r in ngram_join.classes(frame(spark, rows), n=5, percent=80).collect())
    assert got == plain(rows, 5, 80)


def test_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in ngram_join.classes(docs).collect()) == plain(rows)
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in plain(rows)}


def test_linked_sets_share_a_prefix():
    rng = np.random.default_rng(0)
    for percent in (80, 90, 95):
        for size in [*range(1, 60), 100, 333, 2000]:
            pool = np.unique(rng.integers(0, 2**64, size + 400, dtype=np.uint64))
            rng.shuffle(pool)
            common = rng.integers(-(-percent * size // 100), size + 1)
            most = common * 100 // percent - size
            b = np.concatenate((pool[:common], pool[size : size + rng.integers(0, most + 1)])) if most >= 0 else pool[:common]
            a = pool[:size]
            if 100 * common >= percent * (size + len(b) - common):
                heads = [np.sort(x)[: ngram_join.prefix_length(len(x), percent)] for x in (a, b)]
                assert len(np.intersect1d(*heads)), (percent, size)


@pytest.mark.parametrize("rare", [1, 3])
def test_any_rarity_gives_the_same(spark, monkeypatch, rare):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    rows = corpus(7)
    assert Counter(tuple(r) for r in ngram_join.classes(frame(spark, rows)).collect()) == plain(rows)
    assert Counter(tuple(r) for r in ngram_join.classes(frame(spark, rows), n=2, percent=80).collect()) == plain(rows, 2, 80)


def twins(n=4096):
    """A Thue-Morse string and its complement, which hashes modulo 2 ** 64 take for equal."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_unlike_strings_differ(spark):
    x, y = twins()
    rows = [(1, f"{x} {x} {x}"), (2, f"{y} {y} {y}"), (3, " ".join(x)), (4, " ".join(y))]
    assert Counter(tuple(r) for r in ngram_join.classes(frame(spark, rows)).collect()) == plain(rows)


def test_hashes_of_slices_and_windows():
    rng = np.random.default_rng(3)
    buffer = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 3000)
    ends = np.minimum(starts + rng.integers(0, 90, 3000), 4000)
    seen = {}
    for h, s, e in zip(blocks.slice_hashes(buffer, starts, ends).tolist(), starts.tolist(), ends.tolist()):
        assert seen.setdefault(h, bytes(buffer[s:e])) == bytes(buffer[s:e])
    assert len(seen) == len({bytes(buffer[s:e]) for s, e in zip(starts, ends)})
    values = rng.integers(0, 2, 500).astype(np.uint64)
    for length in (1, 2, 3, 5, 8, 20, 21):
        pairs = {(h, tuple(values[k : k + length].tolist())) for k, h in enumerate(blocks.window_hashes(values, length).tolist())}
        assert len(pairs) == len({h for h, _ in pairs}) == len({w for _, w in pairs})


@pytest.mark.parametrize("in_task", [0, 1 << 20])
def test_components(spark, monkeypatch, in_task):
    monkeypatch.setattr(blocks, "IN_TASK", in_task)
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(300)] + [(1000 - k, 1001 - k) for k in range(60)] + [(5000, 2000 + k) for k in range(200)] + [(rng.randint(-90, -1), rng.randint(-90, -1)) for _ in range(70)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    rng.shuffle(edges)
    got = blocks.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert Counter(tuple(r) for r in got) == Counter((x, root(x)) for x in up if root(x) != x)


def test_product_equals_intersections():
    rng = np.random.default_rng(8)
    for dense in (1, 32, 10**9):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        sets = [np.unique(np.concatenate((pool[:150] if k % 3 else pool[:0], rng.choice(pool, rng.integers(1, 200))))) for k in range(60)]
        want = np.array([[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:40]])
        assert (ngram_join._overlaps(sets[:40], sets[20:], dense, 500) == want).all()


def test_repeated_and_missing_ids(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(7, words), (None, words), (7, words), (7, "other " + words[:30]), (3, words + " z"), (None, ""), (None, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("later"), F.lit(2).alias("row"), F.lit(3).alias("_later"))
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, words), (7, rows[3][1]), (None, ""), (None, ""), (9, None)])
    once = docs.filter("text like '% z'").unionByName(docs.filter("doc_id = 9"))
    assert ngram_join.deduplicated(once).count() == 2


def test_empty_table(spark):
    assert ngram_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
