"""Removal of byte strings that occur earlier, by suffix arrays from external induced sorting.

A byte is removed if it lies in a string of `LENGTH` bytes of its document that also starts
earlier (in a smaller doc_id, or earlier in the same document).

*Shards.* The windows of LENGTH bytes are dealt to shards by content, so that equal windows
meet: a window's key is the least hash among its 16-byte grams, and neighbouring windows with
the same key travel as one string. A block of documents sends a string only if its key occurs
twice anywhere, and equal strings of a block only once, so a passage that a third of all
documents hold costs its length once a block. A shard collapses equal strings to the earliest.

*Sorting.* A shard's strings are held in memory and cut into parts by key, each sorted on its own
by `induced` (disk-backed queues with common-prefix values). A part that one key makes too large is
cut again, by the least gram under another hash, so that many contexts of one gram are sorted apart. Neighbours in suffix order that share LENGTH
bytes are one window; all its places but the first are lost. A lost window goes back to its
block as a range of starts, and the block removes the bytes that lost windows cover.

Defined cases: a null or empty text has no bytes; documents without an id come before all
others; rows that share an id are read in the order of their texts, as one document after the
other, so of repeated rows, which tie, any one keeps its bytes; texts of any length are read whole, and a block
holds its own in memory; an empty table gives an empty result; matches never cross rows; a window that
equals the one a byte before it (one byte repeated) is lost without being sorted; where the
kept bytes are wanted as text, cut characters are dropped; extra columns are not read, or kept as they are, of any type (`documents`).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .anchor_dedup import distinct_once, ordered, repeated, returned
from .blocks import PACKED, SEED_A, SEED_B, SEED_C, U64, block_count, bucket_cuts, by_block, chunks_of, eight_bytes, frugal, frugal_pair, in_blocks, isin_sorted, mix, packed_rows, packed_table, partitions
from .induced import BREAK, SENTINEL, SHIFT, equal_windows

LENGTH, GRAM = 100, 16
#: Grams of a window; as many windows can hold one gram.
REACH = LENGTH - GRAM + 1
#: Bytes that a shard sorts at once; only strings with one key by both hashes can exceed it, and then the queues go to disk.
PART = 1 << 22
RANGE = np.dtype([("serial", "<i4"), ("begin", "<i4"), ("end", "<i4")])


class Strings:
    """The keyed strings of several texts: where each run of windows begins, how many there are, and its key."""

    def __init__(self, texts: list[bytes], seed: int = SEED_A):
        self.joined = b"".join(texts)
        self.buffer = np.frombuffer(self.joined, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_ends = np.cumsum(lengths)
        self.text_starts = self.text_ends - lengths
        n = len(self.buffer) - LENGTH + 1
        if n <= 0:
            self.echo = self.starts = self.counts = np.zeros(0, dtype=np.int64)
            self.keys = np.zeros(0, dtype=np.uint64)
            return
        words = eight_bytes(self.buffer)  # a gram is two of them
        grams = words[: len(self.buffer) - GRAM + 1] * U64(seed | 1)
        grams ^= grams >> U64(29)
        grams += words[GRAM // 2 : len(self.buffer) - GRAM // 2 + 1]
        grams *= U64(SEED_C)
        grams ^= grams >> U64(32)
        least = grams
        width = 1
        while 2 * width <= REACH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < REACH:
            least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])
        inside = np.zeros(n + 1, dtype=np.int32)  # whether a window that begins here stays in its text
        long = lengths >= LENGTH
        np.add.at(inside, self.text_starts[long], 1)
        np.add.at(inside, self.text_ends[long] - LENGTH + 1, -1)
        valid = np.cumsum(inside[:n]) > 0
        # windows that equal the one before: LENGTH + 1 equal bytes of one text
        differ = np.concatenate(([0], np.cumsum(self.buffer[1:] != self.buffer[:-1])))
        same = np.zeros(n, dtype=bool)
        same[1:] = differ[LENGTH:] == differ[: n - 1]
        same[self.text_starts[self.text_starts < n]] = False
        same &= valid
        self.echo = np.flatnonzero(same)
        held = valid & ~same
        begins = held.copy()
        begins[1:] &= ~held[:-1] | (least[1:] != least[:-1])
        ends = held.copy()
        ends[:-1] &= begins[1:] | ~held[1:]
        self.starts = np.flatnonzero(begins)
        self.counts = np.flatnonzero(ends) + 1 - self.starts
        self.keys = mix(least[self.starts])
        self._grams = grams

    def selfish(self) -> np.ndarray:
        """Which strings may hold a window twice.

        A run of up to REACH windows has the gram at REACH - 1 in all of them, so a window that
        occurs in it twice has that gram twice. Longer runs have their key's gram twice.
        """
        out = self.counts > REACH
        if len(out):
            at = self.starts + REACH - 1
            for shift in range(1, REACH):
                some = np.flatnonzero((self.counts > shift) & ~out)
                out[some[self._grams[at[some] + shift] == self._grams[at[some]]]] = True
        return out

    def bytes_of(self, k: int) -> bytes:
        s = self.starts[k]
        return self.joined[s : s + self.counts[k] + LENGTH - 1]


def _find_keys(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, texts = ordered(table)
        keys = [np.concatenate((x.keys, x.keys[x.selfish()])) for s, e in chunks_of(texts) for x in [Strings(texts[s:e])]]
        seen = distinct_once(np.concatenate(keys)) if keys else distinct_once(np.zeros(0, np.uint64))
        return packed_table(packed_rows(seen, seen["hash"], buckets, table.column("block")[0].as_py()))

    return run


def _packed(hashes, keys, serials, contents) -> bytes:
    lengths = np.array([-1 if c is None else len(c) for c in contents], dtype="<i4")
    return b"".join([np.int64(len(lengths)).tobytes(), hashes.tobytes(), keys.tobytes(), serials.tobytes(), lengths.tobytes(), *[c for c in contents if c]])


def _unpacked(payload: bytes):
    n = int(np.frombuffer(payload, "<i8", 1)[0])
    at, out = 8, []
    for kind in ("<u8", "<i8", "<i4", "<i4"):
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * out[-1].itemsize
    contents = []
    for size in out[3].tolist():
        contents.append(None if size < 0 else payload[at : at + size])
        at += max(size, 0)
    return out[0], out[1], out[2], contents


def _send(buckets: int):
    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows or not back.num_rows:
            return packed_table([])
        keys, _, texts = ordered(table)
        twice = returned(back, "<u8")
        seen: set[bytes] = set()
        hashes, docs, serials, contents = [], [], [], []
        serial = 0
        for s, e in chunks_of(texts):
            x = Strings(texts[s:e])
            hit = isin_sorted(x.keys, twice)
            for k in np.flatnonzero(hit).tolist():
                content = x.bytes_of(k)
                contents.append(None if content in seen else content)  # None: an earlier string of this block, lost
                seen.add(content)
                serials.append(serial + k)
            hashes.append(x.keys[hit])
            docs.append(np.array(keys[s:e], dtype="<i8")[np.searchsorted(x.text_ends, x.starts[hit], side="right")])
            serial += len(x.keys)
        hashes, docs, serials = np.concatenate(hashes), np.concatenate(docs), np.array(serials, dtype="<i4")
        order = np.argsort(hashes, kind="stable")
        hashes, docs, serials = hashes[order], docs[order], serials[order]
        contents = [contents[k] for k in order]
        cuts = bucket_cuts(hashes, buckets)
        block = table.column("block")[0].as_py()
        return packed_table([(k, block, _packed(hashes[s:e], docs[s:e], serials[s:e], contents[s:e])) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if s < e])

    return run


def _parts(hashes: np.ndarray, sizes: np.ndarray):
    """Ranges of strings in order of key that hold about PART bytes, none cut within a key."""
    start = total = 0
    for k in range(len(hashes)):
        if total + sizes[k] > PART and k > start and hashes[k] != hashes[k - 1]:
            yield start, k
            start, total = k, 0
        total += sizes[k]
    if start < len(hashes):
        yield start, len(hashes)


def _lost_windows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of windows that occur earlier; strings come in order of place."""
    t = np.frombuffer(b"".join([x for s in strings for x in (s, b"\0")] + [b"\0"]), dtype=np.uint8) + np.uint8(SHIFT)
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    t[ends], t[-1] = BREAK, SENTINEL
    of = np.repeat(np.arange(len(strings) + 1, dtype=np.int32), [*(len(s) + 1 for s in strings), 1])  # the string of each place
    stop = np.append(ends, 0)
    lost = []
    for places, starts in equal_windows(t, LENGTH):
        sizes = np.diff(np.append(starts, len(places)))
        head = places[starts]
        good = (sizes > 1) & (head + LENGTH <= stop[of[head]])
        if good.any():
            first = np.repeat(np.where(good, np.minimum.reduceat(places, starts), -1), sizes)
            lost.append(places[(first >= 0) & (places != first)])
    at = np.sort(np.concatenate(lost)) if lost else np.zeros(0, np.int64)
    string = of[at]
    return string, at - np.concatenate(([0], ends + 1))[string]


def _lost_of(strings: list[bytes]):
    """What _lost_windows finds, in groups. Beyond PART bytes strings are cut again by the least gram of another hash, and sorted by it."""
    if sum(map(len, strings)) + len(strings) <= PART:
        yield _lost_windows(strings)
        return
    keys, whose, begins, counts, selfish = [], [], [], [], []
    for s, e in chunks_of(strings):
        x = Strings(strings[s:e], SEED_B)
        which = np.searchsorted(x.text_ends, x.starts, side="right")
        keys.append(x.keys), whose.append(which + s), begins.append(x.starts - x.text_starts[which]), counts.append(x.counts), selfish.append(x.selfish())
    keys, whose, begins, counts, selfish = map(np.concatenate, (keys, whose, begins, counts, selfish))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    order = order[np.concatenate((same, [False])) | np.concatenate(([False], same)) | selfish[order]]
    for s, e in _parts(keys[order], counts[order] + LENGTH):
        some = np.sort(order[s:e])  # in order of place
        string, at = _lost_windows([strings[w][b : b + n + LENGTH - 1] for w, b, n in zip(whose[some].tolist(), begins[some].tolist(), counts[some].tolist())])
        yield whose[some[string]], begins[some[string]] + at


def _sort_shard(table: pa.Table) -> pa.Table:
    blocks, hashes, keys, serials, contents = [], [], [], [], []
    for block, payload in zip(table.column("block").to_pylist(), table.column("payload").to_pylist()):
        h, k, s, c = _unpacked(payload)
        blocks.append(np.full(len(h), block, dtype=np.int32))
        hashes.append(h), keys.append(k), serials.append(s)
        contents += c
    blocks, hashes, keys, serials = map(np.concatenate, (blocks, hashes, keys, serials))
    out_block, out = [], []

    def lose(which: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        rows = np.empty(len(which), dtype=RANGE)
        rows["serial"], rows["begin"], rows["end"] = serials[which], begin, end
        out.append(rows)
        out_block.append(blocks[which])

    # of equal strings only the earliest is sorted; the others are lost as a whole
    order = np.lexsort((serials, keys, hashes))
    first: dict[bytes, int] = {}
    copies = []
    for k in order.tolist():
        content = contents[k]
        if content is None or content in first:
            copies.append(k)
        else:
            first[content] = k
    copies = np.array(copies, dtype=np.int64)
    lose(copies, np.zeros(len(copies), np.int32), np.full(len(copies), np.iinfo(np.int32).max, np.int32))
    kept = np.array(list(first.values()), dtype=np.int64)  # in order of hash
    same = hashes[kept[1:]] == hashes[kept[:-1]]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(kept) else np.zeros(0, bool)
    # a string alone with its key may still hold a window twice: see Strings.selfish
    selfish = np.array([len(c := contents[k]) >= LENGTH + REACH or c.find(c[REACH - 1 : LENGTH], REACH) >= 0 for k in kept.tolist()], dtype=bool)
    kept = kept[shared | selfish]
    sizes = np.array([len(contents[k]) + 1 for k in kept.tolist()], dtype=np.int64)
    for s, e in _parts(hashes[kept], sizes):
        part = kept[s:e][np.lexsort((serials[kept[s:e]], keys[kept[s:e]]))]
        for string, at in _lost_of([contents[k] for k in part.tolist()]):
            if len(at):
                cut = np.flatnonzero((np.diff(string) != 0) | (np.diff(at) != 1)) + 1
                begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)]))
                lose(part[string[begin]], at[begin], at[end - 1] + 1)
    return packed_table(by_block(table.column("bucket")[0].as_py(), np.concatenate(out), np.concatenate(out_block)))


def _remove(table: pa.Table, back: pa.Table) -> pa.Table:
    keys, ids, texts = ordered(table)
    parts = [np.frombuffer(x, dtype=RANGE) for x in back.column("payload").to_pylist()]
    lost = np.concatenate(parts) if parts else np.zeros(0, dtype=RANGE)
    lost = lost[np.argsort(lost["serial"], kind="stable")]
    out = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
    serial = 0
    for s, e in chunks_of(texts):
        x = Strings(texts[s:e])
        own = lost[np.searchsorted(lost["serial"], serial) : np.searchsorted(lost["serial"], serial + len(x.keys))]
        which = own["serial"] - serial
        serial += len(x.keys)
        cover = np.zeros(len(x.buffer) + LENGTH + 1, dtype=np.int32)
        begin = x.starts[which] + own["begin"]
        end = x.starts[which] + np.minimum(own["end"], x.counts[which]) + LENGTH - 1
        np.add.at(cover, begin, 1)
        np.add.at(cover, end, -1)
        np.add.at(cover, x.echo, 1)
        np.add.at(cover, x.echo + LENGTH, -1)
        gone = np.cumsum(cover)[: len(x.buffer)] > 0
        sums = np.concatenate(([0], np.cumsum(gone)))
        spans = gone.copy()
        spans[1:] &= ~gone[:-1]
        spans[x.text_starts[x.text_starts < len(gone)]] |= gone[x.text_starts[x.text_starts < len(gone)]]
        span_sums = np.concatenate(([0], np.cumsum(spans)))
        for k in range(e - s):
            a, b = int(x.text_starts[k]), int(x.text_ends[k])
            n = int(sums[b] - sums[a])
            kept = x.buffer[a:b][~gone[a:b]].tobytes() if n else texts[s + k]
            out["n_bytes"].append(b - a)
            out["n_removed"].append(n)
            out["n_spans"].append(int(span_sums[b] - span_sums[a]))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept.decode("utf-8", "ignore"))
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
    return pa.table(out, schema=pa.schema(kinds))


def _digest_only(table: pa.Table, back: pa.Table) -> pa.Table:
    return _remove(table, back).drop_columns("kept")


def _as(column: pa.ChunkedArray, kind: pa.DataType) -> pa.ChunkedArray | pa.Array:
    """A column in the form that the declared type has (time zones, and which nested values may be null, can differ)."""
    if column.type == kind:
        return column
    try:
        return column.cast(kind)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, pa.ArrowTypeError):
        return pa.array(column.to_pylist(), kind)


def _remove_in_place(names: list[str], schema: T.StructType):
    """Whole documents, their texts without what is lost; a null text stays null."""

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        done = _remove(table, back)
        old, keys = table.column("text").to_pylist(), table.column("key").to_pylist()
        order = sorted(range(len(keys)), key=lambda k: (keys[k], (old[k] or "").encode()))
        table = table.take(pa.array(order, pa.int64()))
        was = table.column("text")
        text = pa.chunked_array([pa.array([None if w is None else t for w, t in zip(was.to_pylist(), done.column("kept").to_pylist())], pa.string())])
        cols = [text if n == "text" else table.column(f"c{k}") for k, n in enumerate(names)]
        return pa.table([_as(c, to_arrow_type(f.dataType)) for c, f in zip(cols, schema.fields)], names=schema.names)

    return run


def documents(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """docs with their own columns, of any type, lost bytes removed from `text`; `n_chars` follows if there is one."""
    names = docs.columns
    carried = [F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)]
    kinds = T.StructType([T.StructField(f"c{k}", docs.schema[n].dataType) for k, n in enumerate(names)])
    out = _shared(docs, carried, blocks, _remove_in_place(names, kinds), kinds)
    back = out.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])
    if "n_chars" in names:
        back = back.withColumn("n_chars", F.when(F.col("text").isNull() | F.col("n_chars").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return back


def deduplicated(docs: DataFrame, texts: bool = True, blocks: int | None = None) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `texts` what is kept."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _shared(docs, [], blocks, _remove if texts else _digest_only, schema + (", kept string" if texts else ""))


def _shared(docs: DataFrame, carried: list, blocks: int | None, remove, schema: str | T.StructType) -> DataFrame:
    buckets = partitions(docs.sparkSession)
    rows = in_blocks(docs, [F.col("text").cast("string").alias("text"), *carried], blocks or block_count(docs)).withColumn("doc_id", F.col("doc_id").cast("long"))
    twice = rows.groupBy("block").applyInArrow(frugal(_find_keys(buckets)), PACKED).groupBy("bucket").applyInArrow(frugal(repeated), PACKED)
    sent = rows.groupBy("block").cogroup(twice.groupBy("block")).applyInArrow(frugal_pair(_send(buckets)), PACKED)
    lost = sent.groupBy("bucket").applyInArrow(frugal(_sort_shard), PACKED)
    return rows.groupBy("block").cogroup(lost.groupBy("block")).applyInArrow(frugal_pair(remove), schema)
