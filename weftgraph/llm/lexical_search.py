"""Ranked lexical search: windowed bucket scoring over a document-partitioned index.

*Index.* Every task sorts its documents by id and cuts them into windows of WINDOW consecutive
ones (and of at most POSTINGS postings). A window is one row: the ids and lengths of its documents,
its terms in order of their hashes, and each term's postings (slot of the document, occurrences).
Building it moves no document to another task. Only terms that an item asks for are kept: they
are told by a bitmap of BITS hashes, whose size does not depend on the items (a term that falls on
another's bit is kept in vain). The index is written to the shared folder and read from there.

*Statistics.* N and L are sums over windows, df sums of postings' counts by term, with a map side.

*Scoring.* Items are dealt to blocks of about BLOCK / 2 entries (item, term). A task goes through its windows; for
an item it scatter-adds what the postings of its terms are worth into an array of WINDOW whole numbers, which
stays in the processor's cache; the terms' bit sets, or-ed, say which slots were touched, and those above
the item's floor go to its heap of k. Each task gives k rows an item; these meet in two rounds.

Defined cases: a null or empty text has no terms: it is in no count and never found. Rows that share
an id are documents of their own, as are rows of items that share an id, repeats included. A null id
(an id of -2 ** 63 is taken for one) comes before all others among ties; equal scores go by id, and
what still ties is alike but for the row it is from. Very long texts are read whole, and have windows of
their own. No items, no documents or no terms give an empty result; extra columns are not read.
Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NO_ID, SEED_A, U64, checkpointed, chunks_of, mix, slice_hashes, texts_of

K, WINDOW = 20, 4096
#: Bounds of memory: text that a task indexes at once, postings of a window, bits of the term bitmap, entries of a block of items.
TEXT, POSTINGS, BITS, BLOCK = 1 << 25, 1 << 22, 1 << 24, 1 << 18
#: Parts of the first round of merging.
MERGE = 64

_BYTE = np.arange(256)
#: Bytes of terms: digits, letters and all bytes of characters beyond ASCII.
_TERM = (_BYTE >= 0x80) | ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of some texts in order, and the number of terms of each text."""
    hashes, counts = [], []
    for s, e in chunks_of(texts):
        # bytes.lower() maps A-Z only
        buffer = np.frombuffer((b" ".join(texts[s:e]) + b" ").lower(), dtype=np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], _TERM[buffer], [False])).view(np.int8)))
        hashes.append(slice_hashes(buffer, edges[::2], edges[1::2]))
        ends = np.cumsum([len(t) + 1 for t in texts[s:e]])
        counts.append(np.diff(np.searchsorted(edges[::2], np.concatenate(([0], ends)))))
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.zeros(0, U64), np.zeros(0, np.int64))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate((starts, [len(values)])))


# ---- items -------------------------------------------------------------------------------


def _item_terms(batches):
    for batch in batches:
        hashes, counts = term_hashes(texts_of(batch.column(1)))
        item = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((hashes, item))
        item, hashes = item[order], hashes[order]
        new = np.concatenate(([True], (item[1:] != item[:-1]) | (hashes[1:] != hashes[:-1]))) if len(item) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        times = np.diff(np.concatenate((at, [len(item)])))
        yield pa.record_batch({"item": batch.column(0).take(pa.array(item[at])), "term": pa.array(hashes[at].view(np.int64)), "times": pa.array(times.astype(np.int64))})


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item, item_id) of every row of items, and (item, term, times) of their terms."""
    # numbered once: the numbers are kept by the checkpoint
    rows = checkpointed(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text")))
    return rows.select("item", "item_id"), rows.select("item", "text").mapInArrow(_item_terms, "item long, term long, times long")


def bitmap(terms: DataFrame) -> np.ndarray:
    """BITS bits, those of the terms set: at most BITS / 64 rows come back."""
    words = terms.selectExpr(f"(term & {BITS - 1}) >> 6 AS word", "shiftleft(1L, cast(term & 63 AS int)) AS bit")
    out = np.zeros(BITS // 64, dtype=np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(U64)


# ---- index -------------------------------------------------------------------------------

INDEX = "n_docs long, n_terms long, payload binary"


def _packed(ids, lengths, terms, counts, slots, times) -> bytes:
    heads = np.array([len(ids), len(terms), len(slots)], dtype="<i8")
    return b"".join(x.tobytes() for x in (heads, ids.astype("<i8"), lengths.astype("<i8"), terms, counts.astype("<i8"), slots.astype("<u2"), times.astype("<i8" if len(times) and times.max() >= 2**31 else "<i4")))


def _unpacked(payload: bytes):
    n, t, p = np.frombuffer(payload, "<i8", 3).tolist()
    out, at = [], 24
    for count, kind in ((n, "<i8"), (n, "<i8"), (t, "<u8"), (t, "<i8"), (p, "<u2")):
        out.append(np.frombuffer(payload, kind, count, at))
        at += count * np.dtype(kind).itemsize
    return *out, np.frombuffer(payload, "<i8" if len(payload) - at == 8 * p and p else "<i4", p, at).astype(np.int64)


def _windows(ids: np.ndarray, texts: list[bytes], wanted: np.ndarray):
    """Index rows of some documents in order of their ids."""
    hashes, n = term_hashes(texts)
    doc = np.repeat(np.arange(len(n)), n)
    bit = hashes & U64(BITS - 1)
    kept = np.flatnonzero((wanted[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1))
    hashes, doc = hashes[kept], doc[kept]
    # postings: equal (document, term) in one
    order = np.argsort(mix(hashes ^ mix(doc.astype(U64) + U64(SEED_A))), kind="stable")
    hashes, doc = hashes[order], doc[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.diff(np.concatenate((at, [len(doc)])))
    hashes, doc = hashes[at], doc[at]
    held = np.flatnonzero(n > 0)  # documents without terms have no slot
    each = np.bincount(doc, minlength=len(n))[held]
    start = 0
    while start < len(held):
        stop = min(start + WINDOW, start + max(1, int(np.searchsorted(np.cumsum(each[start : start + WINDOW]), POSTINGS, side="right"))))
        lo, hi = held[start], held[stop - 1]
        mine = np.flatnonzero((doc >= lo) & (doc <= hi))
        mine = mine[np.lexsort((doc[mine], hashes[mine]))]
        starts, counts = _runs(hashes[mine])
        slots = np.searchsorted(held[start:stop], doc[mine])
        yield stop - start, int(n[held[start:stop]].sum()), _packed(ids[held[start:stop]], n[held[start:stop]], hashes[mine][starts], counts, slots, times[mine])
        start = stop


def _index(wanted: np.ndarray):
    def emit(ids, texts):
        order = np.argsort(ids, kind="stable")
        rows = list(_windows(ids[order], [texts[k] for k in order.tolist()], wanted))
        return pa.record_batch({"n_docs": pa.array([r[0] for r in rows], pa.int64()), "n_terms": pa.array([r[1] for r in rows], pa.int64()), "payload": pa.array([r[2] for r in rows], pa.binary())})

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            column = texts_of(batch.column(1))
            for i, t in zip(batch.column(0).to_numpy(zero_copy_only=False).tolist(), column):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= TEXT:
                    yield emit(np.array(ids, dtype=np.int64), texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield emit(np.array(ids, dtype=np.int64), texts)

    return run


def index(docs: DataFrame, wanted: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a window, with postings of the terms whose bits are set; kept in the shared folder."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    return checkpointed(rows.mapInArrow(_index(wanted), INDEX))


def _frequencies(batches):
    for batch in batches:
        terms, counts = [], []
        for payload in batch.column(0).to_pylist():
            _, _, t, c, _, _ = _unpacked(payload)
            terms.append(t)
            counts.append(c)
        if terms:
            terms, counts = np.concatenate(terms), np.concatenate(counts)
            order = np.argsort(terms, kind="stable")
            starts, _ = _runs(terms[order])
            yield pa.record_batch({"term": pa.array(terms[order][starts].view(np.int64)), "df": pa.array(np.add.reduceat(counts[order], starts) if len(starts) else starts)})


# ---- scoring -----------------------------------------------------------------------------


class Block:
    """Items of a block: item k asks for the terms first[k] : first[k + 1], each worth weight."""

    def __init__(self, rows: list):
        item = np.array([r["item"] for r in rows], dtype=np.int64)
        self.terms, at = np.unique(np.array([r["term"] for r in rows], dtype=np.int64).view(U64), return_inverse=True)
        starts, counts = _runs(item)
        self.items, self.first = item[starts], np.concatenate((starts, [len(item)]))
        self.at, self.weight = at, np.array([r["weight"] for r in rows], dtype=np.int64)


def lengths_measure(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """75 + (25 n N) div L; in Python's numbers where 64 bits might not hold the product."""
    if 25 * int(n.max(initial=0)) * n_docs < 2**63:
        return 75 + (25 * n * n_docs) // n_terms
    return np.array([75 + (25 * x * n_docs) // n_terms for x in n.tolist()], dtype=np.int64)


def _score(block: Block, n_docs: int, n_terms: int, k: int):
    def run(batches):
        heaps = [[] for _ in block.items]
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                _meet(block, n_docs, n_terms, k, payload, heaps)
        rows = [(int(i), d, s) for i, heap in zip(block.items, heaps) for s, d in heap]
        cols = list(zip(*rows)) if rows else [[], [], []]
        yield pa.record_batch({"item": pa.array(cols[0], pa.int64()), "doc": pa.array([~d for d in cols[1]], pa.int64()), "score": pa.array(cols[2], pa.int64())})

    return run


def _meet(block: Block, n_docs: int, n_terms: int, k: int, payload: bytes, heaps: list) -> None:
    """One window against all items of a block. Heaps hold (score, ~id): the least is the first to leave."""
    ids, lengths, terms, counts, slots, times = _unpacked(payload)
    if not len(terms):
        return
    worth = (1_000_000_000 * times) // (1000 * times + 12 * lengths_measure(lengths, n_docs, n_terms)[slots])
    ends = np.cumsum(counts)
    found = np.minimum(np.searchsorted(terms, block.terms), len(terms) - 1)
    run_of = np.where(terms[found] == block.terms, found, -1)[block.at]
    sums, bits = np.zeros(len(ids), dtype=np.int64), {}
    for j in range(len(block.items)):
        s, e = block.first[j], block.first[j + 1]
        runs = run_of[s:e]
        here = np.flatnonzero(runs >= 0)
        if not len(here):
            continue
        touched = None
        for r, w in zip(runs[here].tolist(), block.weight[s:e][here].tolist()):
            a, b = ends[r] - counts[r], ends[r]
            sums[slots[a:b]] += w * worth[a:b]  # slots of a term are distinct
            if r not in bits:
                flags = np.zeros(len(ids), dtype=bool)
                flags[slots[a:b]] = True
                bits[r] = np.packbits(flags)
            touched = bits[r] if touched is None else touched | bits[r]
        occupied = np.flatnonzero(np.unpackbits(touched, count=len(ids)))
        _harvest(heaps[j], ids[occupied], sums[occupied], k)
        sums[occupied] = 0


def _harvest(heap: list, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    floor = heap[0][0] if len(heap) == k else 1
    good = np.flatnonzero(scores >= max(1, floor))
    if len(good) > k:
        good = good[np.lexsort((ids[good], -scores[good]))[:k]]
    for i, s in zip(ids[good].tolist(), scores[good].tolist()):
        if len(heap) < k:
            heapq.heappush(heap, (s, ~i))
        elif (s, ~i) > heap[0]:
            heapq.heapreplace(heap, (s, ~i))


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k highest scores above 0 among all documents."""
    spark = docs.sparkSession
    named, terms = item_terms(items)
    terms = checkpointed(terms)
    windows = index(docs, bitmap(terms))
    size = windows.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    out = spark.createDataFrame([], "item long, doc long, score long")
    if size["l"]:
        df = windows.select("payload").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        w = F.floor(F.lit(1000) * F.log((F.lit(2.0 * size["n"]) + 2) / (2 * F.col("df").cast("double") + 1)))
        asked = checkpointed(terms.join(df, "term").select("item", "term", (F.col("times") * w).cast("long").alias("weight")).filter("weight > 0"))
        blocks = -(-2 * asked.count() // BLOCK)
        found = None
        for b in range(blocks):
            # a bounded part of the items goes to the tasks with their code
            block = Block(asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "term").collect())
            one = windows.select("payload").mapInArrow(_score(block, size["n"], size["l"], k), "item long, doc long, score long")
            found = one if found is None else found.unionByName(one)
        out = out if found is None else found
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc"))
    out = out.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE)))
    out = out.withColumn("at", best("item", "part")).filter(F.col("at") <= k)
    out = out.withColumn("rank", best("item")).filter(F.col("rank") <= k)
    return out.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")
