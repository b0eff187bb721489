"""Exact top-k inner products over an index of pivots and distances.

Components become whole numbers, floor(SCALE * x), so scores are exact. One more coordinate,
sqrt(M ** 2 - |x| ** 2) with M the largest norm (0 for queries), makes the inner product fall
with the distance: |q - x| ** 2 = |q| ** 2 + M ** 2 - 2 q.x, and distances obey the triangle
inequality. Every vector is keyed by its nearest pivot and its distance to it; a pivot's
vectors are cut by distance into annuli, and large annuli (of many equal vectors, say) into
slices of bounded size.

A query first meets the annuli with the best bounds that hold k vectors; the k-th score found
is its threshold. Then it meets every other annulus whose bound reaches the threshold: if a
vector lies between distances r0 and r1 from a pivot, and the query at distance d, the vector
is at least max(d - r1, r0 - d) from the query. Annuli beyond that are never read. Pivots are a
bounded sample (the PIVOTS smallest hashes), which affects the speed only; the search is exact.

Defined cases: vectors that are null or hold a null or non-finite component, or whose id is
null, take no part; vectors of each dimension (of none, too) have their own index and are each
other's only candidates; ties in score go to the smaller id; rows that share an id are all candidates for other
queries, and one query (the one whose bytes come first); fewer than k candidates are all
returned; extra columns are not read. Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, K = 1024.0, 10
#: Pivots, annuli of a pivot, and vectors of a slice: parameters of speed.
PIVOTS, ANNULI, SLICE = 64, 32, 4096


def _whole(batches):
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        keep_id, keep, norms = [], [], []
        for i, x in zip(ids.to_pylist(), column.to_pylist()):
            if i is None or x is None or None in x:
                continue
            v = np.array(x, dtype=np.float64)
            if not np.isfinite(v).all():
                continue
            q = np.floor(SCALE * v).astype("<i8")
            keep_id.append(i)
            keep.append(q.tobytes())
            norms.append(float((q.astype(np.float64) ** 2).sum()))
        yield pa.record_batch({"vec_id": pa.array(keep_id, pa.int64()), "q": pa.array(keep, pa.binary()), "norm2": pa.array(norms, pa.float64())})


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, q, norm2) of the vectors that take part; q is the scaled components as bytes."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_whole, "vec_id long, q binary, norm2 double")


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(b, dtype="<i8") for b in column]) if column else np.zeros((0, 0), np.int64)


def _lifted(q: np.ndarray, m2: float) -> np.ndarray:
    x = q.astype(np.float64)
    return np.concatenate((x, np.sqrt(np.maximum(0, m2 - (x * x).sum(1)))[:, None]), axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T))


def _assign(pivots: np.ndarray, m2: float, width: float):
    def run(batches):
        for batch in batches:
            q = _matrix(batch.column(1).to_pylist())
            if not len(q):
                continue
            d = _distances(_lifted(q, m2), pivots)
            pivot = d.argmin(1)
            r = d[np.arange(len(d)), pivot]
            yield pa.record_batch({"vec_id": batch.column(0), "q": batch.column(1), "pivot": pa.array(pivot.astype(np.int32)), "ring": pa.array(np.floor(r / width).astype(np.int32)), "r": pa.array(r)})

    return run


class Index:
    """Annuli: (pivot, ring), vectors, least and greatest distance, first shard and slices."""

    def __init__(self, rows, pivots: np.ndarray, m2: float):
        rows = sorted(rows, key=lambda x: (x["pivot"], x["ring"]))
        self.pivots, self.m2 = pivots, m2
        self.pivot = np.array([x["pivot"] for x in rows], dtype=np.int64)
        self.n = np.array([x["n"] for x in rows], dtype=np.int64)
        self.r0, self.r1 = np.array([x["r0"] for x in rows]), np.array([x["r1"] for x in rows])
        self.slices = -(-self.n // SLICE)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No score of a query in an annulus is above this."""
        x = np.concatenate((q.astype(np.float64), np.zeros((len(q), 1))), axis=1)
        d = _distances(x, self.pivots)[:, self.pivot]
        slack = 1e-6 * (1 + d + self.r1)  # rounding of distances
        least = np.maximum(0, np.maximum(d - self.r1, self.r0 - d) - slack)
        top = ((x * x).sum(1)[:, None] + self.m2 - least * least) / 2
        return top + 1 + 1e-9 * np.abs(top)

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """The annuli with the best bounds that surely hold k other vectors, as a mask."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(out, order, before < k + 1, axis=1)
        return out


def _rows(index: Index, ids: np.ndarray, q: np.ndarray, mask: np.ndarray, floors: np.ndarray):
    """(annulus, slice, payload): the queries that meet each shard."""
    out = []
    for a in np.flatnonzero(mask.any(0)).tolist():
        who = np.flatnonzero(mask[:, a])
        payload = np.int64(len(who)).tobytes() + ids[who].astype("<i8").tobytes() + floors[who].astype("<i8").tobytes() + q[who].astype("<i8").tobytes()
        out += [(a, s, payload) for s in range(int(index.slices[a]))]
    cols = list(zip(*out)) if out else [[], [], []]
    return pa.record_batch({"annulus": pa.array(cols[0], pa.int32()), "slice": pa.array(cols[1], pa.int32()), "queries": pa.array(cols[2], pa.binary())})


LOWEST = np.iinfo(np.int64).min


def _ask(index: Index, k: int, second: bool):
    def run(batches):
        for batch in batches:
            ids, q = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1).to_pylist())
            if not len(q):
                continue
            bounds = index.bounds(q)
            mask = index.first(bounds, k)
            floors = np.full(len(ids), LOWEST, dtype=np.int64)
            if second:
                floors = np.array([LOWEST if x is None else x for x in batch.column(2).to_pylist()], dtype=np.int64)
                mask = ~mask & (bounds >= floors[:, None].astype(np.float64))
            yield _rows(index, ids, q, mask, floors)

    return run


FOUND = "query_id long, vec_id long, score long"


def _meet(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        ids = np.array(vectors.column("vec_id").to_pylist(), dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], _matrix(vectors.column("q").to_pylist())
        x = x[order] if len(x) else x
        for payload in queries.column("queries").to_pylist() if len(ids) else []:
            n = int(np.frombuffer(payload, "<i8", 1)[0])
            who, floors = np.frombuffer(payload, "<i8", n, 8), np.frombuffer(payload, "<i8", n, 8 + 8 * n)
            q = np.frombuffer(payload, "<i8", -1, 8 + 16 * n).reshape(n, -1)
            exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**52
            for s in range(0, n, 256):
                part = q[s : s + 256]
                scores = (part.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if exact else part @ x.T
                for row in range(len(part)):
                    # ids are in order, so a stable sort puts the smaller first among ties
                    good = np.flatnonzero((ids != who[s + row]) & (scores[row] >= floors[s + row]))
                    best = good[np.argsort(-scores[row][good], kind="stable")[:k]]
                    out_q.append(np.full(len(best), who[s + row]))
                    out_v.append(ids[best])
                    out_s.append(scores[row][best])
        cat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query_id": cat(out_q), "vec_id": cat(out_v), "score": cat(out_s)})

    return run


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query (a condition on vec_id) the k highest scores among other ids."""
    every = whole_vectors(vectors)
    width_of = (F.length("q") / 8).cast("int")
    queries = every.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("q").alias("q"))
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # one row a dimension
    for r in every.groupBy(width_of.alias("width")).agg(F.max("norm2").alias("m2")).orderBy("width").collect():
        out = out.unionByName(_top_k(every.filter(width_of == r["width"]), queries.filter(width_of == r["width"]), r["m2"], k))
    return out


def _top_k(every: DataFrame, queries: DataFrame, m2: float, k: int) -> DataFrame:
    """The same among whole vectors of one dimension; m2 is their largest squared norm."""
    spark = every.sparkSession
    sample = every.orderBy(F.xxhash64("q", "vec_id"), "vec_id").limit(PIVOTS).collect()  # a bounded sample
    pivots = np.unique(_lifted(_matrix([bytes(r["q"]) for r in sample]), m2), axis=0)
    ring = max(1.0, 2 * float(np.sqrt(m2)) / ANNULI)
    keyed = every.select("vec_id", "q").mapInArrow(_assign(pivots, m2, ring), "vec_id long, q binary, pivot int, ring int, r double")
    # at most PIVOTS * (ANNULI + 1) rows, as no distance is above 2 M
    rows = keyed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1")).collect()
    index = Index(rows, pivots, m2)
    at = {(r["pivot"], r["ring"]): a for a, r in enumerate(sorted(rows, key=lambda x: (x["pivot"], x["ring"])))}
    annuli = spark.createDataFrame([(p, g, a, int(index.slices[a])) for (p, g), a in at.items()], "pivot int, ring int, annulus int, slices int")
    shards = keyed.join(F.broadcast(annuli), ["pivot", "ring"]).select("vec_id", "q", "annulus", F.pmod(F.xxhash64("vec_id", F.col("r")), F.col("slices")).cast("int").alias("slice"))
    shards = shards.groupBy("annulus", "slice")
    asked = "annulus int, slice int, queries binary"
    one = shards.cogroup(queries.mapInArrow(_ask(index, k, False), asked).groupBy("annulus", "slice")).applyInArrow(_meet(k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    floors = one.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    again = queries.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "q", "floor")
    two = shards.cogroup(again.mapInArrow(_ask(index, k, True), asked).groupBy("annulus", "slice")).applyInArrow(_meet(k), FOUND)
    both = one.select("query_id", "vec_id", "score").unionByName(two).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return both.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
