"""N-gram Jaccard join by a blocked sparse matrix product of documents by n-grams.

Two documents link if 100 * |A & B| >= PERCENT * |A | B| over their sets of distinct word
n-grams. The result is the class of each document: the smallest id reachable over links.

*Size-derived bounds.* A link allows at most min(|A|, |B|) * (100 - PERCENT) / PERCENT n-grams
in one set only, and so bounds the size of a partner and the overlap that it must reach.

*Blocks, high thresholds.* Sizes are cut into classes so wide that a partner is in the same
class or the next; for either pair of classes the bound is a number d. An n-gram's hash deals
it to one of d + 1 parts. Differing n-grams touch at most d parts, so linked documents have a
part that is equal; the sum of its hashes is a key, and documents that share no key are never
compared. An empty part proves nothing: a document with d or fewer parts that hold anything is
dealt anew by another hash, up to LEVELS times, and after that shares one key with its like.
A key is some nine n-grams wide, so neither chance nor a passage that many documents share
makes it common unless most of the documents is equal.

*Blocks, lower thresholds.* Parts would be too narrow. With all n-grams in any one order, two
linked sets share one of their first |A| - ceil(PERCENT * |A| / 100) + 1 n-grams: their
prefixes. The order is by rarity: n-grams of low hash that at most RARE documents have, then
those of high hash, then the common ones of low hash. Documents send their n-grams of low hash.
Rare ones are multiplied out: pairs of documents and how many they share. A pair is discarded
unless that, with all that it may share among common n-grams and those of high hash, can reach
the overlap of a link. Where an n-gram is common, its documents learn that they have one rare
n-gram less; only documents whose prefix is then not filled send their next n-grams, to each
other. A batch sends an n-gram at most RARE + 1 times.

The documents of a key of parts, or of next n-grams, are connected by a tree, not by all pairs,
in a batch first and then between the batches' roots: a key that a third of all documents have
costs an entry a batch, and its documents an edge each.

*Product.* Documents connected as candidates are a cluster; of documents with equal sets only one
takes part. A cluster is cut into chunks of bounded weight; a chunk is a sparse incidence matrix
that is multiplied by itself and by the first chunk, tile of documents by tile, adding overlap
counts. N-grams that the same documents of a tile have are one weighted column; columns that most
of a tile has are multiplied as a panel, the others scattered. Pairs of sizes beyond the bound are
never formed, nor pairs of documents that links connect already. Where several chunks remain
unconnected, what is outside the largest class of its cluster meets every chunk, in chunks. Links
become trees inside the task, so a group of copies costs its size in rows, not its square. No
partner is dropped at any size.

Defined cases: a null or empty text, or one without words, has an empty set, links with
nothing and is its own class; a text with fewer than N words has its whole sequence as one
n-gram; a very long text is one set like any other; equal sets link, whatever their ids; rows that
share an id are one document whose links are those of any of its rows, and each row keeps its own
n_shingles; a row without an id links with nothing and has a null class; extra columns are not
read. N-grams are compared by 64-bit hashes, equal sets by 128 bits.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PACKED_EDGES, PAIR, SEED_C, U64, Words, bucket_cuts, checkpointed, chunks_of, components, forest, free_name, frugal, mix, pack_edges, packed_edge_table, packed_edges, partitions, sliced, texts_of, window_hashes

#: Thresholds from here on use parts, lower ones rare prefixes; and how often a set is dealt anew.
PARTS_FROM, LEVELS = 88, 8
#: Documents of a rare n-gram, at most; the result is the same for any number.
RARE = 16
NO_DOC = np.iinfo(np.int64).min
#: N-gram entries of one chunk of a cluster.
CHUNK = 1 << 22
KEYED = np.dtype([("key", "<u8"), ("doc", "<i8")])
FACT = np.dtype([("kind", "<i8"), ("a", "<i8"), ("b", "<i8"), ("c", "<i8")])


# ---- sets and keys --------------------------------------------------------------------------


def sets_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's lower-cased word n-grams."""
    out = []
    for s, e in chunks_of(texts):
        w = Words(texts[s:e], lower=True)
        hashes = w.hashes()
        windows = window_hashes(hashes, n)
        for k in range(e - s):
            a, b = int(w.first[k]), int(w.first[k + 1])
            if a == b:
                out.append(np.zeros(0, dtype=U64))
            elif b - a < n:
                out.append(window_hashes(hashes[a:b], b - a))
            else:
                own = np.sort(windows[a : b - n + 1])
                out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
    return out


class Sizes:
    """Size classes for a threshold in percent, and the differing n-grams that each pair of classes allows."""

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]

    def _grow(self) -> None:
        self.starts.append(self.starts[-1] * 100 // self.percent + 1)

    def class_of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self._grow()
        return bisect_right(self.starts, size) - 1

    def differing(self, cls: int) -> int:
        """Of two linked sets, the smaller in class cls: n-grams in one set only, at most."""
        while len(self.starts) < cls + 2:
            self._grow()
        return (self.starts[cls + 1] - 1) * (100 - self.percent) // self.percent


def keys_of(grams: np.ndarray, sizes: Sizes) -> np.ndarray:
    """The keys of a set: linked sets share at least one."""
    own = sizes.class_of(len(grams))
    out = []
    for cls in (own - 1, own):
        if cls < 0:
            continue
        d = sizes.differing(cls)
        dealt = grams
        for level in range(LEVELS + 1):
            salt = U64((cls * (LEVELS + 1) + level) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            if level == LEVELS:
                out.append(mix(np.array([salt])))
                break
            if level:
                dealt = np.sort(mix(dealt + salt))
            part = ((dealt >> U64(32)) * U64(d + 1)) >> U64(32)
            begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sums = np.add.reduceat(mix(dealt ^ salt), begin)
            out.append(mix(sums + mix(part[begin] + salt)))
            if len(begin) > d:
                break
    return np.concatenate(out)


def prefix_length(size: int, percent: int) -> int:
    return size + (-percent * size // 100) + 1


def low_cut(percent: int) -> int:
    """Hashes below this are low: half as many again as a prefix has."""
    return min(2**64 - 1, 3 * (100 - percent) * 2**64 // 200)


def _stars(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Edges from each key's least document to its others, each once. Both arrays are in order of key, then document."""
    begin = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    least = docs[np.maximum.accumulate(np.where(begin, np.arange(len(keys)), 0))] if len(keys) else docs
    edges = np.empty(len(keys), dtype=PAIR)
    edges["a"], edges["b"] = least, docs
    return np.unique(edges[least != docs])


def _collapsed(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key once with the root of its documents, and an edge from every other document to its root."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    edges = _stars(keys, docs)
    nodes, roots = forest(edges["a"], edges["b"])
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    keys, docs = keys[first], docs[first]
    if len(nodes):
        at = np.minimum(np.searchsorted(nodes, docs), len(nodes) - 1)
        docs = np.where(nodes[at] == docs, roots[at], docs)
    other = nodes != roots
    return keys, docs, roots[other], nodes[other]


def _groups(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys: how many are equal to each."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    return np.repeat(np.diff(cuts), np.diff(cuts))


ROWS = "bucket int, payload binary"
#: Kinds of facts (kind, a, b, c): documents a and b share c rare n-grams; document a has b common n-grams of low
#: hash; it has b n-grams in all, c of low hash; it has b of low hash beyond a prefix, common ones included.
SHARED, COMMON, SIZE, SPARE = 0, 1, 2, 3
FACTS = "kind long, a long, b long, c long"


def _made(kind: int, a: np.ndarray, b, c=0) -> np.ndarray:
    out = np.empty(len(a), dtype=FACT)
    out["kind"], out["a"], out["b"], out["c"] = kind, a, b, c
    return out


def _fact_table(facts: np.ndarray) -> pa.Table:
    return pa.table({f: pa.array(np.ascontiguousarray(facts[f])) for f in FACT.names})


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch({"bucket": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def _send(keys: np.ndarray, docs: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    records = np.empty(len(keys), dtype=KEYED)
    records["key"], records["doc"] = keys, docs
    cuts = bucket_cuts(keys, buckets)
    return [(k, records[s:e].tobytes()) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if s < e]


def _emit_low(n: int, percent: int, buckets: int):
    """Postings (bucket, n-grams of low hash with their documents); bucket -1 has facts of documents.

    Hashes of low n-grams are spread over all buckets by a mix. An n-gram that more than RARE
    documents of the batch have is common already: RARE + 1 postings say so, and its documents
    are told here.
    """

    def run(batches):
        cut = np.uint64(low_cut(percent))
        for batch in sliced(batches):
            ids, sets = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sets_of(texts_of(batch.column(1)), n)
            sizes = np.array([len(g) for g in sets], dtype=np.int64)
            low = [g[: np.searchsorted(g, cut)] for g in sets]
            lows = np.array([len(g) for g in low], dtype=np.int64)
            keys, docs = mix(np.concatenate(low)) if len(low) else np.zeros(0, U64), np.repeat(ids, lows)
            rows = np.repeat(np.arange(len(sets)), lows)
            order = np.lexsort((docs, keys))
            keys, docs, rows = keys[order], docs[order], rows[order]
            times = _groups(keys)
            often = times > RARE
            common = np.bincount(rows[often], minlength=len(sets))
            known = [_made(SIZE, ids, sizes, lows), _made(COMMON, ids, common), _made(SPARE, ids, lows - (sizes + (-percent * sizes // 100) + 1))]
            known = np.concatenate([k[sizes > 0] for k in known])
            first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
            place = np.arange(len(keys)) - np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)
            sent = ~often | (place <= RARE)
            # markers of what is common already name no document
            yield _rows([(-1, known.tobytes())] * bool(len(known)) + _send(keys[sent], np.where(often, NO_DOC, docs)[sent], buckets))

    return run


def _emit_more(n: int, percent: int, buckets: int):
    """Postings of short documents: their next n-grams of high hash, and where those do not suffice the low ones too."""

    def run(batches):
        cut = np.uint64(low_cut(percent))
        for batch in sliced(batches):
            ids, sets = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sets_of(texts_of(batch.column(1)), n)
            found = []
            for g, lack in zip(sets, batch.column(2).to_pylist()):
                at = int(np.searchsorted(g, cut))
                found.append(g[at : at + lack] if at + lack <= len(g) else g)
            keys, docs = (mix(np.concatenate(found)) if found else np.zeros(0, U64)), np.repeat(ids, [len(f) for f in found])
            yield _keyed_rows(*_collapsed(keys, docs), buckets)

    return run


def _emit_parts(n: int, percent: int, buckets: int):
    """Postings of the parts' keys, each once a batch with the root of its documents; what connects the batch's documents is found here."""

    def run(batches):
        sizes = Sizes(percent)
        for batch in sliced(batches):
            ids, sets = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sets_of(texts_of(batch.column(1)), n)
            found = [keys_of(g, sizes) if len(g) else g for g in sets]
            keys, docs = (np.concatenate(found) if found else np.zeros(0, U64)), np.repeat(ids, [len(f) for f in found])
            yield _keyed_rows(*_collapsed(keys, docs), buckets)

    return run


def _passed_on(table: pa.Table) -> pa.Table:
    return _fact_table(np.concatenate([np.frombuffer(p, dtype=FACT) for p in table.column("payload").to_pylist()]))


def _postings(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    records = np.concatenate([np.frombuffer(p, dtype=KEYED) for p in table.column("payload").to_pylist()])
    order = np.lexsort((records["doc"], records["key"]))
    return records["key"][order], records["doc"][order]


def _keyed_rows(keys: np.ndarray, docs: np.ndarray, a: np.ndarray, b: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Postings, and in bucket -1 - part the edges that the batch has found itself."""
    return _rows([(-1 - part, payload) for part, payload in packed_edges(a, b, buckets)] + _send(keys, docs, buckets))


def _link_stars(buckets: int):
    """Packed edges between the documents of a bucket's keys; a negative bucket holds edges that batches found."""

    def run(table: pa.Table) -> pa.Table:
        if (bucket := table.column("bucket")[0].as_py()) < 0:
            return packed_edge_table([(-1 - bucket, p) for p in table.column("payload").to_pylist()])
        return packed_edge_table(packed_edges(*_collapsed(*_postings(table))[2:], buckets))

    return run


def _multiply_rare(rare: int):
    """The product's entries from a bucket's rare n-grams: pairs of documents and how many of these they share.

    Of common n-grams, each document's count. Bucket -1 holds facts of documents.
    """

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return _passed_on(table)
        keys, docs = _postings(table)
        often = _groups(keys) > rare
        told, counts = np.unique(docs[often & (docs != NO_DOC)], return_counts=True)
        keys, docs = keys[~often], docs[~often]
        pairs = [np.zeros(0, dtype=PAIR)]
        for shift in range(1, rare):
            same = (keys[shift:] == keys[:-shift]) & (docs[shift:] != docs[:-shift])
            part = np.empty(int(same.sum()), dtype=PAIR)
            part["a"], part["b"] = docs[:-shift][same], docs[shift:][same]
            pairs.append(part)
        pairs = np.concatenate(pairs)
        order = np.lexsort((pairs["b"], pairs["a"]))
        pairs = pairs[order]
        new = np.flatnonzero(np.concatenate(([True], (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])))) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(pairs)))
        return _fact_table(np.concatenate((_made(SHARED, pairs["a"][new], pairs["b"][new], times), _made(COMMON, told, counts))))

    return run


# ---- product --------------------------------------------------------------------------------


def _overlaps(sets_a: list[np.ndarray], sets_b: list[np.ndarray], dense: int = 32, most: int = 1 << 22) -> np.ndarray:
    """The product of two tiles' incidence matrices: how many n-grams each pair of documents shares."""
    rows, cols = len(sets_a), len(sets_b)
    overlap = np.zeros(rows * cols)
    grams_a, grams_b = np.concatenate(sets_a), np.concatenate(sets_b)
    both = np.intersect1d(grams_a, grams_b)
    if not len(both):
        return overlap.reshape(rows, cols)

    def incidence(sets: list[np.ndarray], grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents by n-gram that both tiles have, in order of n-gram."""
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, grams), len(both) - 1)
        held = both[at] == grams
        doc, at = doc[held], at[held]
        order = np.argsort(at, kind="stable")
        return doc[order], np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(both)))))

    doc_a, cut_a = incidence(sets_a, grams_a)
    doc_b, cut_b = incidence(sets_b, grams_b)
    # columns with the same documents are one column with their number as weight
    same = mix(np.add.reduceat(mix(doc_a.astype(U64) + U64(SEED_C)), cut_a[:-1])) + np.add.reduceat(mix(doc_b.astype(U64) + U64(1)), cut_b[:-1])
    _, column, weight = np.unique(same, return_index=True, return_counts=True)
    size_a, size_b = np.diff(cut_a)[column], np.diff(cut_b)[column]
    full = size_a * size_b * dense > rows * cols
    for s in range(0, int(full.sum()), 1024):
        some = column[full][s : s + 1024]
        left, right = np.zeros((rows, len(some)), dtype=np.float32), np.zeros((len(some), cols), dtype=np.float32)
        for k, c in enumerate(some.tolist()):
            left[doc_a[cut_a[c] : cut_a[c + 1]], k] = 1
            right[k, doc_b[cut_b[c] : cut_b[c + 1]]] = weight[full][s + k]
        overlap += (left @ right).ravel()  # whole numbers far below 2 ** 24: exact
    column, weight, size_a, size_b = column[~full], weight[~full], size_a[~full], size_b[~full]
    total = np.cumsum(size_a * size_b)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most)))
        # every entry of a column in the one tile meets every entry in the other
        entries = np.repeat(np.arange(at, end), size_a[at:end])
        place = np.arange(len(entries)) - np.repeat(np.cumsum(size_a[at:end]) - size_a[at:end], size_a[at:end])
        left, times = doc_a[cut_a[column[entries]] + place], size_b[entries]
        place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        right = doc_b[np.repeat(cut_b[column[entries]], times) + place]
        overlap += np.bincount(np.repeat(left, times) * cols + right, weights=np.repeat(weight[entries], times), minlength=rows * cols)
        at = end
    return overlap.reshape(rows, cols)


class _Classes:
    """Labels of positions; a label is the least position that links connect it to."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.label[i], self.label[j]
        differ = i != j
        if differ.any():
            nodes, roots = forest(i[differ], j[differ])
            to = np.arange(len(self.label))
            to[nodes] = roots
            self.label = to[self.label]


def _connect(found: _Classes, sets: list[np.ndarray], sizes: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, percent: int, tile: int = 1024) -> None:
    """Join all positions of_a and of_b that link. Both are in order of size, and may be the same."""
    itself = of_a is of_b
    size_b = sizes[of_b]
    for s in range(0, len(of_a), tile):
        rows = of_a[s : s + tile]
        # size-derived bounds: |a| * percent <= 100 * |b| and the other way round
        lo = s if itself else int(np.searchsorted(size_b * 100, sizes[rows[0]] * percent))
        hi = int(np.searchsorted(size_b * percent, sizes[rows[-1]] * 100, side="right"))
        for t in range(lo, hi, tile):
            cols = of_b[t : min(hi, t + tile)]
            # only what is outside the tiles' commonest class can link anew
            label = found.label
            names, counts = np.unique(label[np.concatenate((rows, cols))], return_counts=True)
            if len(names) == 1:
                continue
            main = names[np.argmax(counts)]
            out_a, out_b = label[rows] != main, label[cols] != main
            halves = [(rows, cols)] if itself and s == t else [(rows[out_a], cols), (rows[~out_a], cols[out_b])]
            for i, j in halves:
                if not len(i) or not len(j):
                    continue
                overlap = _overlaps([sets[k] for k in i.tolist()], [sets[k] for k in j.tolist()]).astype(np.int64)
                union = sizes[i][:, None] + sizes[j][None, :] - overlap
                x, y = np.nonzero((100 * overlap >= percent * union) & (overlap > 0))
                found.join(i[x], j[y])


def _multiply(n: int, percent: int):
    """Trees of the links inside a chunk, and with the cluster's other side that the task holds."""

    def run(table: pa.Table) -> pa.Table:
        # rows of `side` 0 meet each other and side 1; side 1 has met itself elsewhere
        docs, cluster = (np.array(table.column(c).to_pylist(), dtype=np.int64) for c in ("doc_id", "cluster"))
        side = np.array(table.column("side").to_pylist(), dtype=np.int64)
        sets = sets_of(texts_of(table.column("text")), n)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        order = np.lexsort((docs, sizes, side, cluster))
        order = order[sizes[order] > 0]
        found = _Classes(len(sets))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(cluster[order])) + 1, [len(order)])).tolist()
        for s, e in zip(cuts[:-1], cuts[1:]):
            mid = s + int(np.searchsorted(side[order[s:e]], 1))
            own, other = order[s:mid], order[mid:e]
            _connect(found, sets, sizes, own, own, percent)
            if len(other) and len(own):
                _connect(found, sets, sizes, own, other, percent)
        nodes, roots = forest(docs[found.label], docs)
        joined = nodes != roots
        return pa.table({"a": pa.array(roots[joined]), "b": pa.array(nodes[joined])})

    return run


EDGES = "a long, b long"


def candidates(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Packed edges that connect all documents that may link, directly or not."""
    parts = partitions(rows.sparkSession)
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("payload"), F.lit(parts))).alias("spread")
    if percent >= PARTS_FROM:
        return rows.mapInArrow(_emit_parts(n, percent, parts), ROWS).groupBy("bucket", spread).applyInArrow(frugal(_link_stars(parts)), PACKED_EDGES)
    low = rows.mapInArrow(_emit_low(n, percent, parts), ROWS).groupBy("bucket", spread)
    facts = checkpointed(low.applyInArrow(frugal(_multiply_rare(RARE)), FACTS))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    later = F.coalesce(F.sum(of(COMMON, F.col("b"))), F.lit(0))
    known = facts.filter(F.col("kind") != SHARED).groupBy(F.col("a").alias("doc_id")).agg(
        F.min(of(SIZE, F.col("b"))).alias("size"), F.max(of(SIZE, F.col("b") - F.col("c"))).alias("high"), later.alias("common"), (F.min(of(SPARE, F.col("b"))) - later).alias("spare")
    )
    known = checkpointed(known)
    # the size-derived bound: what a pair shares, and all that it may share unseen
    pairs = facts.filter(F.col("kind") == SHARED).groupBy("a", "b").agg(F.sum("c").alias("shared"))
    for end in ("a", "b"):
        pairs = pairs.join(known.select(F.col("doc_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("size", "high", "common")]), end)
    most = F.col("shared") + F.least("common_a", "common_b") + F.least("high_a", "high_b")
    pairs = pairs.filter(most * (100 + percent) >= (F.col("size_a") + F.col("size_b")) * percent)
    short = known.filter("spare < 0").select("doc_id", (-F.col("spare")).alias("lack"))
    more = rows.join(short, "doc_id").select("doc_id", "text", "lack").mapInArrow(_emit_more(n, percent, parts), ROWS).groupBy("bucket", spread)
    return pack_edges(pairs.select("a", "b")).unionByName(more.applyInArrow(frugal(_link_stars(parts)), PACKED_EDGES))


def _profile(n: int):
    def run(batches):
        for batch in sliced(batches):
            sets = sets_of(texts_of(batch.column(1)), n)
            one, two = (np.array([mix(s ^ seed).sum(dtype=U64) if len(s) else 0 for s in sets], dtype=U64).view(np.int64) for seed in (U64(0), U64(SEED_C)))
            yield pa.record_batch({"doc_id": batch.column(0), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "one": pa.array(one), "two": pa.array(two)})

    return run


def profiles(docs: DataFrame, n: int) -> DataFrame:
    """One row a document: doc_id, the size of its set, and 128 bits that equal sets share. Kept in the shared folder."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return checkpointed(texts.mapInArrow(_profile(n), "doc_id long, n_shingles long, one long, two long"))


def links(docs: DataFrame, n: int, percent: int, chunk: int = CHUNK, known: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between ids that connect every class of linked documents. known: the documents' profiles."""
    parts = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    known = (profiles(docs, n) if known is None else known).filter("doc_id is not null and n_shingles > 0")
    equal = known.groupBy("one", "two").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).filter("a <> last").drop("last")
    copies = checkpointed(known.join(equal, ["one", "two"]).filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct())
    # of equal sets the one of the least id takes part; an id with several sets takes part by all of them
    sized = known.groupBy("doc_id").agg(F.sum("n_shingles").alias("weight"), (F.min("one") != F.max("one")).alias("several"))
    found = components(candidates(rows, n, percent))
    named = found.select(F.col("root").alias("doc_id"), F.col("root").alias("cluster")).distinct().unionByName(found.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster")))
    again = copies.select(F.col("b").alias("doc_id")).distinct().withColumn("again", F.lit(True))
    members = named.join(sized, "doc_id").join(again, "doc_id", "left").filter("again is null or several").select("doc_id", "cluster", "weight")
    members = checkpointed(members)
    chunks = members.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.sum("weight") / F.lit(chunk))).cast("int").alias("chunks"), F.count("*").alias("documents")).filter("documents > 1")
    dealt = members.join(chunks, "cluster").select("doc_id", "cluster", "weight", "chunks", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk"))
    dealt = checkpointed(dealt)
    many = not dealt.filter("chunks > 1").isEmpty()
    if many:
        # the first chunk of a large cluster goes to all its chunks
        task = F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
        placed = dealt.select("doc_id", "cluster", "chunks", "chunk", F.explode(task).alias("task"))
        placed = placed.select("doc_id", "cluster", "chunks", "task", ((F.col("chunk") == 0) & (F.col("task") > 0)).cast("int").alias("side"))
    else:
        placed = dealt.select("doc_id", "cluster", "chunks", F.lit(0).alias("task"), F.lit(0).alias("side"))
    # clusters of one chunk share tasks; a chunk of a larger one has its own
    group = F.when(F.col("chunks") > 1, F.xxhash64("cluster", "task")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(4 * parts)))

    def product(where: DataFrame) -> DataFrame:
        texts = rows.join(where, "doc_id").select("doc_id", "text", "cluster", "side", "task_key")
        return texts.groupBy("task_key").applyInArrow(frugal(_multiply(n, percent)), EDGES)

    edges = product(placed.withColumn("task_key", group).select("doc_id", "cluster", "side", "task_key"))
    if not many:
        return edges.unionByName(copies)
    edges = checkpointed(edges)
    # what is not yet in the largest class of its cluster meets every chunk of the cluster
    label = components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("label"))
    large = dealt.filter("chunks > 1").join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    main = large.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    outside = checkpointed(large.join(main, "cluster").filter("label <> main").select("doc_id", "cluster", "weight", "chunks"))
    outer = outside.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.sum("weight") / F.lit(chunk))).cast("int").alias("outer_chunks"))
    each = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("task")
    left = outside.join(outer, "cluster").select("doc_id", "cluster", each, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("outer_chunks")).cast("int").alias("part"), F.lit(0).alias("side"))
    right = large.join(outer, "cluster").select("doc_id", "cluster", F.col("chunk").alias("task"), F.explode(F.sequence(F.lit(0), F.col("outer_chunks") - 1)).alias("part"), F.lit(1).alias("side"))
    second = left.unionByName(right).withColumn("task_key", F.xxhash64("cluster", "task", "part"))
    return edges.unionByName(product(second.select("doc_id", "cluster", "side", "task_key"))).unionByName(copies)


def classes(docs: DataFrame, n: int = 3, percent: int = 90, chunk: int = CHUNK) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    known = profiles(docs, n)
    found = components(links(docs, n, percent, chunk, known)).select(F.col("node").alias("doc_id"), "root")
    return known.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """docs with one document of each class: the one of the least id.

    Where ids repeat or are missing, rows are numbered and each is a document of its own, so that
    of repeated rows, too, one stays: the one of the least id (none counts as the least), then of
    the least number. Documents without words stay, every one.
    """
    ids = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if ids["rows"] == ids["ids"]:
        found = components(links(docs, n, percent)).select(F.col("node").alias(later := free_name(docs, "later")))
        return docs.join(found, F.col("doc_id") == F.col(later), "left_anti")
    numbered = checkpointed(docs.withColumn(row := free_name(docs, "row"), F.monotonically_increasing_id()))
    found = components(links(numbered.select(F.col(row).alias("doc_id"), "text"), n, percent))
    rooted = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    named = rooted.join(numbered.select(F.col(row).alias("node"), F.col("doc_id").cast("long").alias("id")), "node")
    first = named.groupBy("root").agg(F.min_by("node", F.struct("id", "node")).alias("node"))
    gone = rooted.join(first, "node", "left_anti").select(F.col("node").alias(later := free_name(numbered, "later")))
    return numbered.join(gone, F.col(row) == F.col(later), "left_anti").drop(row)
