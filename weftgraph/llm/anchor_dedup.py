"""Removal of word windows that occur earlier, found by difference-cover anchors.

A window is `WINDOW` consecutive words of one document. It is removed, with all its words, if
the same words also start earlier (in a smaller doc_id, or earlier in the same document).

*Anchors.* Windows of `ANCHOR` words are hashed only where their place in the document is in
the cover {0, 1, 3, 9} modulo 13. Every residue is a difference of two cover members, so two
equal windows at any places i and j share some shift d < 13 with both i + d and j + d covered:
they share an anchor of 20 - 13 + 1 = 8 words. Only the windows around an anchor that occurs
twice are then extended to all 20 words, and compared by 96-bit hashes.

*Scale.* Blocks of documents (`blocks.in_blocks`) send each distinct anchor, and then each
distinct window with its first place, once. A passage that a third of all documents hold costs
one entry a block at every step; no group of occurrences meets in one task. What comes back to
a block are the hashes that occur elsewhere, and the windows that are earlier elsewhere; the
block finds the places itself from its texts, whose one exchange all three steps reuse.

Defined cases: a null or empty text has no words; documents without an id come before all
others; rows that share an id are read in the order of their texts, as one document after the
other, so of repeated rows, which tie, any one keeps its words and all others lose theirs; texts of any length are
one sequence of words, whose windows are never cut; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PACKED, SEED_B, SEED_C, Words, block_count, by_block, chunks_of, in_blocks, isin_sorted, packed_rows, packed_table, partitions, starts_within, texts_of, unpacked, window_hashes

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1

SEEN = np.dtype([("hash", "<u8"), ("times", "u1")])
PLACED = np.dtype([("hash", "<u8"), ("more", "<u4"), ("key", "<i8")])
LOST = np.dtype([("hash", "<u8"), ("more", "<u4")])


def ordered(table: pa.Table) -> tuple[list, list, list[bytes]]:
    """Keys, ids and texts of a block, in the order in which occurrences count."""
    keys, ids, texts = table.column("key").to_pylist(), table.column("doc_id").to_pylist(), texts_of(table.column("text"))
    order = sorted(range(len(keys)), key=lambda k: (keys[k], texts[k]))
    return [keys[k] for k in order], [ids[k] for k in order], [texts[k] for k in order]


def distinct_once(hashes: np.ndarray) -> np.ndarray:
    """Each hash once, sorted, with 1 or (for more) 2 as the times it occurs here."""
    found, times = np.unique(hashes, return_counts=True)
    out = np.empty(len(found), dtype=SEEN)
    out["hash"], out["times"] = found, np.minimum(times, 2)
    return out


def repeated(table: pa.Table) -> pa.Table:
    """A bucket's hashes that occur twice or more, sent back to each block that has them."""
    records, blocks = unpacked(table, SEEN)
    order = np.argsort(records["hash"], kind="stable")
    records, blocks = records[order], blocks[order]
    same = records["hash"][1:] == records["hash"][:-1]
    twice = records["times"] > 1
    twice[1:] |= same
    twice[:-1] |= same
    bucket = table.column("bucket")[0].as_py()
    return packed_table(by_block(bucket, records["hash"][twice], blocks[twice]))


def returned(table: pa.Table, dtype) -> np.ndarray:
    """What all buckets sent to a block, sorted by hash."""
    parts = [np.frombuffer(x, dtype=dtype) for x in table.column("payload").to_pylist()]
    out = np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)
    return np.sort(out) if out.dtype.names is None else out[np.argsort(out["hash"], kind="stable")]


def _places(w: Words) -> np.ndarray:
    """Each word's place in its text."""
    return np.arange(len(w.starts)) - np.repeat(w.first[:-1], w.counts)


def _anchors(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where anchors begin, and their hashes."""
    windows = window_hashes(hashes, ANCHOR)
    covered = np.zeros(PERIOD, dtype=bool)
    covered[list(COVER)] = True
    at = np.flatnonzero((starts_within(w.counts, ANCHOR) & covered[_places(w) % PERIOD])[: len(windows)])
    return at, windows[at]


def _windows(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows begin, and two hashes of each."""
    one, two = window_hashes(hashes, WINDOW, SEED_B), window_hashes(hashes, WINDOW, SEED_C)
    at = np.flatnonzero(starts_within(w.counts, WINDOW)[: len(one)])
    return at, one[at], (two[at] >> np.uint64(32)).astype(np.uint32)


def _find_anchors(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, texts = ordered(table)
        found = [_anchors(w := Words(texts[s:e]), w.hashes())[1] for s, e in chunks_of(texts)]
        seen = distinct_once(np.concatenate(found)) if found else np.zeros(0, dtype=SEEN)
        return packed_table(packed_rows(seen, seen["hash"], buckets, table.column("block")[0].as_py()))

    return run


def _extend(buckets: int):
    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows or not back.num_rows:
            return packed_table([])
        keys, _, texts = ordered(table)
        twice = returned(back, "<u8")
        found = []
        for s, e in chunks_of(texts):
            w = Words(texts[s:e])
            hashes = w.hashes()
            at, anchor = _anchors(w, hashes)
            near = np.zeros(len(w.starts) + PERIOD + 1, dtype=np.int64)
            near[at[isin_sorted(anchor, twice)] + 1] = 1
            np.cumsum(near, out=near)
            start, one, two = _windows(w, hashes)
            held = near[start + PERIOD] > near[start]
            key = np.array(keys[s:e], dtype=np.int64)[np.searchsorted(w.first[1:], start[held], side="right")]
            part = np.empty(int(held.sum()), dtype=PLACED)
            part["hash"], part["more"], part["key"] = one[held], two[held], key
            found.append(part)
        placed = np.concatenate(found)
        placed = placed[np.lexsort((placed["more"], placed["hash"]))]  # stable: the first place stays first
        new = np.ones(len(placed), dtype=bool)
        new[1:] = (placed["hash"][1:] != placed["hash"][:-1]) | (placed["more"][1:] != placed["more"][:-1])
        placed = placed[new]
        return packed_table(packed_rows(placed, placed["hash"], buckets, table.column("block")[0].as_py()))

    return run


def _earlier(table: pa.Table) -> pa.Table:
    """Windows that another block has first, sent back to the blocks that have them later."""
    records, blocks = unpacked(table, PLACED)
    order = np.lexsort((records["key"], records["more"], records["hash"]))
    records, blocks = records[order], blocks[order]
    later = np.zeros(len(records), dtype=bool)
    later[1:] = (records["hash"][1:] == records["hash"][:-1]) & (records["more"][1:] == records["more"][:-1])
    lost = np.empty(int(later.sum()), dtype=LOST)
    lost["hash"], lost["more"] = records["hash"][later], records["more"][later]
    return packed_table(by_block(table.column("bucket")[0].as_py(), lost, blocks[later]))


def _pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Both hashes as one 64-bit value for looking up; 96 bits decide within a block's few windows."""
    return one ^ (two.astype(np.uint64) * np.uint64(SEED_C))


def _remove(table: pa.Table, back: pa.Table) -> pa.Table:
    keys, ids, texts = ordered(table)
    lost = returned(back, LOST)
    gone = np.sort(_pairs(lost["hash"], lost["more"]))
    parts = [(s, e, w := Words(texts[s:e]), *_windows(w, w.hashes())) for s, e in chunks_of(texts)]
    values = [_pairs(p[4], p[5]) for p in parts]
    joined = np.concatenate(values) if values else np.zeros(0, np.uint64)
    order = np.argsort(joined, kind="stable")
    again = np.zeros(len(joined), dtype=bool)
    again[order[1:]] = joined[order[1:]] == joined[order[:-1]]
    again |= isin_sorted(joined, gone)
    out = {"doc_id": ids, "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
    at = 0
    for s, e, w, start, _, _ in parts:
        cover = np.zeros(len(w.starts) + WINDOW + 1, dtype=np.int32)
        first = start[again[at : at + len(start)]]
        at += len(start)
        cover[first] += 1
        cover[first + WINDOW] -= 1
        removed = np.cumsum(cover)[: len(w.starts)] > 0
        n_removed = np.add.reduceat(np.concatenate((removed, [False])), np.minimum(w.first[:-1], len(removed))) if len(w.counts) else []
        for k in range(e - s):
            words = texts[s + k].split()
            n = int(n_removed[k]) if w.counts[k] else 0
            if n:
                words = list(compress(words, (~removed[w.first[k] : w.first[k + 1]]).tolist()))
            kept = b" ".join(words)
            out["n_words"].append(int(w.counts[k]))
            out["n_removed"].append(n)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept.decode("utf-8", "replace"))
    return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]))


def _digest_only(table: pa.Table, back: pa.Table) -> pa.Table:
    return _remove(table, back).drop_columns("kept")


def deduplicated(docs: DataFrame, texts: bool = True, blocks: int | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256, and with `texts` what is kept."""
    buckets = partitions(docs.sparkSession)
    rows = in_blocks(docs, [F.col("text").cast("string").alias("text")], blocks or block_count(docs)).withColumn("doc_id", F.col("doc_id").cast("long"))
    twice = rows.groupBy("block").applyInArrow(_find_anchors(buckets), PACKED).groupBy("bucket").applyInArrow(repeated, PACKED)
    placed = rows.groupBy("block").cogroup(twice.groupBy("block")).applyInArrow(_extend(buckets), PACKED)
    lost = placed.groupBy("bucket").applyInArrow(_earlier, PACKED)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return rows.groupBy("block").cogroup(lost.groupBy("block")).applyInArrow(_remove if texts else _digest_only, schema + (", kept string" if texts else ""))
