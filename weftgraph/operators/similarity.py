"""Clones and nearest vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import checkpointed

#: Statements of a window, and the least similarity of near clones.
WINDOW, NEAR = 5, 0.6


def line_windows(text: Column, size: int = WINDOW) -> Column:
    """Hashes of every `size` consecutive lines; of all lines if there are fewer. JVM expressions only."""
    return windows_of(F.split(text, "\n"), size)


def windows_of(lines: Column, size: int = WINDOW) -> Column:
    """The same of an array of statements, which is computed once a row."""

    def windows(held: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(held) - size + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(held, i, F.lit(size)), "\n").cast("binary")), 1, 16))

    return _let(lines, windows)


def exact_groups(units: DataFrame) -> DataFrame:
    """(fingerprint, members, first): fingerprints of two units or more. Counts only, so a hot one costs a row a task."""
    return units.filter("fingerprint <> ''").groupBy("fingerprint").agg(F.count("*").alias("members"), F.min("unit").alias("first")).filter("members >= 2")


def near_pairs(units: DataFrame, least: float = NEAR) -> DataFrame:
    """(a, b, similarity) of pairs of units (unit, windows) whose window sets have Jaccard >= least.

    Units with equal window sets are one class, whose first unit stands for it; classes(units)
    gives the members. Sets are joined on their prefix: with windows in order of frequency, two
    similar sets share one of their first |x| - ceil(least * |x|) + 1, the rarest ones. The first window that
    two sets share bounds what they can share by what follows it in each, so most pairs of a common window go in
    the join itself, before their sets are fetched; the join splits a window that very many sets begin with.
    """
    w = classes(units).filter("unit = class").select(F.col("class").alias("unit"), "windows")
    each = w.select("unit", F.size("windows").alias("n"), F.explode("windows").alias("w"))
    df = each.groupBy("w").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = each.join(df, "w", "left").groupBy("unit").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "w"))).alias("s"))
    cut = (F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)) + 1).cast("int")
    prefix = ranked.select("unit", "n", F.posexplode(F.slice("s", F.lit(1), cut)).alias("at", "x")).filter("x.df > 1").select("unit", "n", (F.col("n") - F.col("at")).alias("left"), F.col("x.w").alias("w"))
    other = prefix.withColumnsRenamed({"unit": "b", "n": "nb", "left": "left_b"})
    possible = F.least("left_a", "left_b") >= F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - F.lit(1e-9)
    sizes = (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))
    candidates = prefix.withColumnsRenamed({"unit": "a", "n": "na", "left": "left_a"}).join(other, "w").filter((F.col("a") < F.col("b")) & sizes & possible).select("a", "b").distinct()
    sets = w.select("unit", "windows")
    pairs = candidates.join(sets.withColumnsRenamed({"unit": "a", "windows": "wa"}), "a").join(sets.withColumnsRenamed({"unit": "b", "windows": "wb"}), "b")
    both = F.size(F.array_intersect("wa", "wb"))
    jaccard = both / (F.size("wa") + F.size("wb") - both)
    return pairs.select("a", "b", F.round(jaccard, 6).alias("similarity"), jaccard.alias("j")).filter(F.col("j") >= least).drop("j")


def classes(units: DataFrame) -> DataFrame:
    """(unit, windows, class): units by their set of windows; the class is its first unit."""
    sets = units.select("unit", F.array_sort(F.array_distinct("windows")).alias("windows")).withColumn("key", F.sha2(F.array_join("windows", ",").cast("binary"), 256))
    first = sets.groupBy("key").agg(F.min("unit").alias("class"))
    return sets.join(first, "key").select("unit", "windows", "class")


def totals(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """(groups, members, pairs): groups of exact clones (unit, fingerprint), the units in them, and near pairs. One row."""
    exact = exact_groups(units).agg(F.count("*").alias("groups"), F.coalesce(F.sum("members"), F.lit(0)).alias("members"))
    return exact.crossJoin(F.broadcast(pairs.agg(F.count("*").alias("pairs"))))  # one row each


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for a zero norm or unequal lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def nearest(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """The k rows of vectors (id, vector) most like the one row of query (vector); a top-k report."""
    q = F.broadcast(query.select(F.col("vector").alias("q")).limit(1))  # one row
    return vectors.crossJoin(q).select("id", F.round(cosine(F.col("vector"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


#: Vectors, and queries, up to which a side of the product is one block; blocks that a larger side is cut into, and most rows of a block.
CELL, SIDE, MOST = 4096, 6, 65536
#: Queries that are multiplied at once with CELL vectors.
STEP = 1024
#: Two scores that are equal when rounded to six places differ by less.
SLACK = 2e-6


def _unit(batches, name: str):
    """(id, vector as bytes, width) of unit length; zero vectors stay zero."""
    for batch in batches:
        column = batch.column(1)
        ids, rows = [], []
        for i, v in zip(batch.column(0).to_pylist(), column.to_pylist()):
            if i is not None and v is not None and None not in v:
                x = np.array(v, dtype=np.float64)
                norm = np.sqrt(x @ x)
                ids.append(i)
                rows.append(x / norm if norm > 0 and np.isfinite(norm) else np.zeros(len(x)))
        yield pa.record_batch({name: pa.array(ids, batch.schema.field(0).type), "unit": pa.array([x.tobytes() for x in rows], pa.binary()), "width": pa.array([len(x) for x in rows], pa.int32())})


def _matrix(table: pa.Table) -> np.ndarray:
    """The unit vectors of a block, a row each."""
    parts, width = [], table.column("width")[0].as_py()
    offset = np.int64 if pa.types.is_large_binary(table.schema.field("unit").type) else np.int32
    for chunk in table.column("unit").chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], dtype=offset)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(parts).view(np.float64).reshape(table.num_rows, width)


def _product(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("id", queries.schema.field("id").type), ("other", vectors.schema.field("other").type), ("score", pa.float64())])
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = _matrix(vectors), _matrix(queries)
        # ties go by id, whose order is Arrow's
        rank = np.empty(vectors.num_rows, dtype=np.int64)
        rank[pa.compute.sort_indices(vectors.column("other")).to_numpy()] = np.arange(vectors.num_rows)
        found = [(who + first, at, score) for first in range(0, len(q), STEP) for who, at, score in [_best(q[first : first + STEP], x, rank, k)]]
        who, at, score = (np.concatenate(c) for c in zip(*found))
        return pa.table([queries.column("id").take(pa.array(who)), vectors.column("other").take(pa.array(at)), pa.array(score)], schema=schema)

    return run


def _best(q: np.ndarray, x: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the k greatest rounded scores of each query, ties by rank; a part of the vectors at a time."""
    who, at, score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    floor = np.full(len(q), -np.inf)
    for first in range(0, len(x), CELL):
        raw = q @ x[first : first + CELL].T
        n = raw.shape[1]
        if first == 0 and n > k:
            floor = np.partition(raw, n - k, axis=1)[:, n - k] - SLACK
        row, column = np.nonzero(raw >= floor[:, None])
        who, at, score = np.concatenate([who, row]), np.concatenate([at, column + first]), np.concatenate([score, np.round(raw[row, column], 6) + 0.0])
        order = np.lexsort((rank[at], -score, who))
        who, at, score = who[order], at[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        who, at, score, place = (c[place < k] for c in (who, at, score, place))
        last = place == k - 1
        floor[who[last]] = score[last] - SLACK
    return who, at, score


def _blocks(vectors: int, queries: int) -> tuple[int, int]:
    """Into how many blocks each side is cut. Where both are large, each is copied SIDE times until its blocks hold MOST rows."""
    if min(vectors, queries) <= CELL:
        # the small side is one block, or none is needed: its copies are no more than the rows of the other
        return max(1, -(-vectors // CELL)), max(1, -(-queries // CELL))
    return max(SIDE, -(-vectors // MOST)), max(SIDE, -(-queries // MOST))


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(id, other, score, rank): of each query (id, vector) the k most alike of vectors (id, vector), by cosine to six places, ties by id.

    A blocked product: both sides are made unit vectors once and dealt to a grid of cells of at most about
    MOST vectors by MOST queries of one length; a cell multiplies parts of its blocks and keeps k rows a query. So each
    task holds two bounded blocks, a row moves SIDE times up to SIDE * MOST rows a side (and once for each MOST rows of the
    other side beyond), and what is merged is k rows a query and block. Null ids and
    vectors, and vectors that hold a null, take no part; vectors of another length than the
    query's are not compared with it; of equal rows each counts.
    """
    kind = lambda df: df.schema["id"].dataType.simpleString()
    columns = {"other": vectors, "id": queries}
    made = {name: checkpointed(df.select(F.col("id").alias(name), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(lambda b, name=name: _unit(b, name), f"{name} {kind(df)}, unit binary, width int")) for name, df in columns.items()}
    cells = dict(zip(made, _blocks(*(df.count() for df in made.values()))))
    # a block of one side meets every block of the other
    dealt = lambda name: F.pmod(F.xxhash64(name, "unit"), F.lit(cells[name])).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.lit(cells[name] - 1)))
    left = made["other"].select("other", "unit", "width", dealt("other").alias("block"), every("id").alias("asks"))
    right = made["id"].select("id", "unit", "width", dealt("id").alias("asks"), every("other").alias("block"))
    keys = ("width", "block", "asks")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_product(k), f"id {kind(queries)}, other {kind(vectors)}, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _let(value: Column, f) -> Column:
    """f(value), with value computed once a row: a lambda's variable is not expanded into the expressions that use it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def hash_embedding(text: Column, dimensions: int = 256) -> Column:
    """A deterministic unit vector: the text's SHA-256 expanded by a counter, four bytes a component. JVM expressions only."""
    count = F.sequence(F.lit(0), F.lit(-(-dimensions // 8) - 1))
    digests = lambda seed: F.transform(count, lambda i: F.sha2(F.concat(seed, F.unhex(F.lpad(F.hex(i.cast("long")), 8, "0"))), 256))
    value = lambda d, j: (F.conv(F.substring(d, j * 8 + 1, 8), 16, 10).cast("double") / F.lit(float(2**32 - 1))) * 2 - 1
    raw = _let(F.unhex(F.sha2(text.cast("binary"), 256)), lambda seed: F.slice(F.flatten(F.transform(digests(seed), lambda d: F.array(*[value(d, j) for j in range(8)]))), 1, dimensions))
    norm = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, v: s + v * v))
    return _let(raw, lambda r: _let(norm(r), lambda n: F.transform(r, lambda v: F.when(n > 0, v / n).otherwise(v))))
