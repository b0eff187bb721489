"""Shared plumbing: hashes over Arrow text, document blocks, packed exchanges, components.

*Hashes.* A word is hashed by its bytes, a window of words by joining the hashes of its halves;
every step ends in a bijective finaliser, so no arrangement of words cancels out.

*Document blocks.* `in_blocks` deals documents to blocks by a hash of their id. Within a block
everything is pre-aggregated: a block sends each distinct hash once, however many of its
documents hold it, so a value that a third of all documents share costs one entry a block.

*Packed exchanges.* What blocks send is sorted by hash and cut into bucket ranges; one row
carries one block's share of one bucket as bytes, so the JVM moves few large rows.
"""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Seeds of hashes that must be independent of each other.
SEED_A, SEED_B, SEED_C = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
_ODD = U64(0x9FB21C651E98DF25)
#: Slices longer than this are hashed one by one.
_LONG = 64
#: Order of documents without an id: before all others.
NO_ID = -(2**63)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker (functions are pickled by value)."""
    return sys.__dict__.setdefault("_weft_worker_cache", {})


def give_back() -> None:
    """Hand back to the system what nothing holds any more: Arrow's pool and the C library keep it otherwise, and a worker lives through many stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def frugal(run):
    """A function of one group's table that gives memory back when the group is done."""

    def one(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return one


def frugal_pair(run):
    """The same of two cogrouped tables."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return both


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def eight_bytes(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one word, first byte lowest; zeros follow the end."""
    padded = np.concatenate((buffer, np.zeros(8, dtype=np.uint8)))
    return np.ndarray((len(buffer) + 1,), dtype="<u8", buffer=padded, strides=(1,))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def slice_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of slices of bytes: all slices at once, eight bytes at a time; long ones by xxh3."""
    words, lengths = eight_bytes(buffer), ends - starts
    out = mix(lengths.astype(U64) + U64(SEED_A))
    live, at = np.flatnonzero((lengths > 0) & (lengths <= _LONG)), 0
    while len(live):
        left = lengths[live] - at
        out[live] = mix(out[live] ^ (words[starts[live] + at] & _MASKS[np.minimum(left, 8)]))
        at += 8
        live = live[left > 8]
    view = memoryview(buffer)
    for k in np.flatnonzero(lengths > _LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(view[starts[k] : ends[k]])
    return out


def window_hashes(values: np.ndarray, length: int, seed: int = SEED_B) -> np.ndarray:
    """Hashes of every `length` consecutive numbers, by their starts: windows of one, two, four ... are joined."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    block, span, out, have = mix(values.astype(U64) ^ U64((seed + length) & (2**64 - 1))), 1, None, 0
    while True:
        if length & span:
            out = block[:n] if out is None else mix(out * _ODD + block[have : have + n])
            have += span
        if 2 * span > length:
            return out
        block = mix(block[:-span] * _ODD + block[span:])
        span *= 2


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null as empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def chunks_of(texts: list[bytes], limit: int = 1 << 17):
    """Ranges of texts of about `limit` bytes together, so that arrays stay in the processor's cache."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def sliced(batches, limit: int = 1 << 23):
    """Arrow batches in slices of about `limit` bytes."""
    for batch in batches:
        step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for s in range(0, batch.num_rows, step):
            yield batch.slice(s, step)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of several texts: byte places in their joined buffer, and hashes."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b" ".join(texts) + b" "
        self.buffer = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_ends = np.cumsum(lengths)
        self.text_starts = self.text_ends - lengths
        inside = ~((self.buffer == 0x20) | ((self.buffer >= 9) & (self.buffer <= 13)))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        #: words of text k are first[k] : first[k + 1]
        self.first = np.searchsorted(self.starts, np.concatenate((self.text_starts, self.text_ends[-1:])))
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return slice_hashes(self.buffer, self.starts, self.ends)


def starts_within(counts: np.ndarray, length: int) -> np.ndarray:
    """Of consecutive sequences with these counts: which places begin a window that stays in its sequence."""
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(len(ends)) + length <= ends


# ---- exchange --------------------------------------------------------------------------


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def in_blocks(docs: DataFrame, columns: list[str], blocks: int) -> DataFrame:
    """docs' doc_id and columns with `block`, from a hash of the id (null: as NO_ID)."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), key.alias("key"), F.col("doc_id"), *columns)


#: Least text of a block, unless one holds the whole table.
BLOCK_BYTES = 1 << 19


def block_count(docs: DataFrame) -> int:
    """Blocks to deal docs to: four a partition, but none of less text than BLOCK_BYTES.

    A bucket sends a row back to each block, so without this their number would be the square of the
    partitions however small the table is.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    return max(1, min(4 * partitions(docs.sparkSession), -(-size // BLOCK_BYTES)))


def bucket_cuts(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins and ends in sorted hashes."""
    edges = [(k << 64) // buckets for k in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(sorted_hashes, np.array(edges, dtype=U64)), [len(sorted_hashes)]))


def packed_rows(records: np.ndarray, hashes: np.ndarray, buckets: int, block: int) -> list[tuple[int, int, bytes]]:
    """(bucket, block, bytes) rows of records that are sorted by hash."""
    cuts = bucket_cuts(hashes, buckets)
    return [(k, block, records[cuts[k] : cuts[k + 1]].tobytes()) for k in range(buckets) if cuts[k] < cuts[k + 1]]


PACKED = "bucket int, block int, payload binary"


def packed_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def unpacked(table: pa.Table, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of a bucket, and the block that each is from."""
    parts = [np.frombuffer(x, dtype=dtype) for x in table.column("payload").to_pylist()]
    blocks = np.repeat(np.array(table.column("block").to_pylist(), dtype=np.int32), [len(p) for p in parts])
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)), blocks


def by_block(bucket: int, records: np.ndarray, blocks: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows that send each record back to its block; records' order is kept."""
    order = np.argsort(blocks, kind="stable")
    records, blocks = records[order], blocks[order]
    cuts = np.flatnonzero(np.diff(blocks)) + 1
    return [(bucket, int(blocks[s]), records[s:e].tobytes()) for s, e in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(blocks)]))) if s < e]


def isin_sorted(values: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    if not len(sorted_list):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(sorted_list, values)
    return sorted_list[np.minimum(at, len(sorted_list) - 1)] == values


# ---- lineage and components --------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share. Where none is set, a local session gets a temporary one; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and re.fullmatch(r"local(\[.*\])?", sc.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])
PACKED_EDGES = "part int, payload binary"
#: So few edges between trees (16 MB) are connected in one task; more are contracted in rounds until no more are left.
IN_TASK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges (a, b) in order, and the least node that each is connected to."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def packed_edges(a: np.ndarray, b: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Rows of edges from each tree's least node to its others, by a hash of the other."""
    nodes, roots = forest(a, b)
    other = nodes != roots
    nodes, roots = nodes[other], roots[other]
    part = (mix(nodes.astype(np.int64).view(U64)) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.empty(len(nodes), dtype=PAIR)
    edges["a"], edges["b"] = roots[order], nodes[order]
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return [(k, edges[s:e].tobytes()) for k, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if s < e]


def packed_edge_table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def pack_edges(edges: DataFrame) -> DataFrame:
    """Edges (a, b) as rows for `components`; each batch sends a spanning forest only."""
    parts = partitions(edges.sparkSession)

    def run(batches):
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            yield from packed_edge_table(packed_edges(a, b, parts)).to_batches()

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, PACKED_EDGES)


def _trees(table: pa.Table) -> pa.Table:
    edges = np.concatenate([np.frombuffer(p, dtype=PAIR) for p in table.column("payload").to_pylist()])
    nodes, roots = forest(edges["a"], edges["b"])
    other = nodes != roots
    return pa.table({"a": pa.array(roots[other]), "b": pa.array(nodes[other])})


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), of every node that is not its own root.

    `edges` has columns a and b, or is packed by `packed_edges`. Edges are dealt by their larger
    node and contracted to trees; a hub is the smaller node of its edges, so no task holds all of
    them. While more than IN_TASK edges are left, every node hooks to its least neighbour (an
    aggregate with a map side) and the edges between hooked nodes are contracted again: rounds
    grow with the logarithm of the nodes. The rest, a bounded number, is connected in one task.
    """
    contracted = lambda packed: checkpointed(packed.groupBy("part").applyInArrow(_trees, "a long, b long"))
    left = contracted(edges if "payload" in edges.columns else pack_edges(edges))
    levels = []
    while left.count() > IN_TASK:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).filter("up < node"))
        levels.append(up)
        for end in ("a", "b"):
            left = left.join(up.select(F.col("node").alias(end), "up"), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
        left = contracted(pack_edges(left.filter("a <> b")))
    one = pack_edges(left).groupBy(F.pmod("part", F.lit(1))).applyInArrow(_trees, "a long, b long")
    labels = one.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for up in reversed(levels):
        heads = labels.select(F.col("node").alias("up"), "root")
        labels = labels.unionByName(up.join(heads, "up", "left").select("node", F.coalesce("root", "up").alias("root")))
    # a node that hooked, and to which others hooked, comes twice, with one root
    return labels.groupBy("node").agg(F.min("root").alias("root")) if levels else labels


# ---- one struct a text --------------------------------------------------------------------


def text_struct(make, ddl: str):
    """An Arrow UDF from a text column to a struct; make() runs in the worker and returns a
    function from a list of UTF-8 texts (null: empty) to a dict of columns."""

    def run(column: pa.Array) -> pa.Array:
        out = make()(texts_of(column))
        return pa.StructArray.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in out.values()], names=list(out))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ddl).asNondeterministic()


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever extra columns it holds."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
