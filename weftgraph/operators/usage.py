"""Quotas, latencies and rate limits over event rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import checkpointed


def masked_path(path: Column) -> Column:
    """A request's path with `{id}` for parts that look like ids: 12 or more hexadecimal digits and dashes."""
    parts = F.split(F.regexp_replace(F.coalesce(path, F.lit("")), "^/+|/+$", ""), "/")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda p: F.when((F.length(p) >= 12) & F.lower(p).rlike("^[0-9a-f-]+$"), "{id}").otherwise(p)), "/"))


def quota(events: DataFrame, unit: str = "day") -> DataFrame:
    """events (user_id, action, tokens, at): tokens and actions of each user and day (or month)."""
    return events.groupBy("user_id", F.date_trunc(unit, "at").cast("date").alias("period")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("actions"))


def over_quota(used: DataFrame, limits: DataFrame) -> DataFrame:
    """used joined to limits (user_id, token_limit): whether the limit is reached; without a limit it never is."""
    return used.join(limits, "user_id", "left").withColumn("exceeded", F.coalesce(F.col("tokens") >= F.col("token_limit"), F.lit(False)))


def latencies(samples: DataFrame, last: int | None = 1000) -> DataFrame:
    """samples (route, at, id, duration): count, sum, and the sorted durations at index int(n * q), of the last ones of each route; of all, if `last` is None."""
    if last is None:
        g = samples.filter("duration IS NOT NULL").groupBy("route").agg(F.round(F.sum("duration"), 4).alias("total"))
        q = exact_quantiles(samples, [0.5, 0.99]).groupBy("route").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("q") == p, F.col("duration"))).alias(name) for name, p in (("p50", 0.5), ("p99", 0.99))])
        return q.join(g, "route").select("route", "n", "total", "p50", "p99")
    if last:
        order = Window.partitionBy("route").orderBy(F.desc("at"), F.desc("id"))
        samples = samples.withColumn("row", F.row_number().over(order)).filter(F.col("row") <= last)
    g = samples.groupBy("route").agg(F.count("*").alias("n"), F.sum("duration").alias("total"), F.array_sort(F.collect_list("duration")).alias("d"))
    at = lambda q: F.element_at("d", (F.floor(F.col("n") * q) + 1).cast("int"))
    return g.select("route", "n", F.round("total", 4).alias("total"), at(0.5).alias("p50"), at(0.99).alias("p99"))


#: Ranges of a round, rows of a range that are sorted at last, and targets that may be broadcast.
BINS, SMALL, FEW = 1024, 4096, 100_000


def _scaled(column: str) -> Column:
    """A value where a range [lo, hi] is cut evenly: by the values if they are of one size and sign, else by their sizes (exponent and mantissa, which keep the order)."""
    alike = "(signum(lo) = signum(hi) AND greatest(abs(lo), abs(hi)) <= 4 * least(abs(lo), abs(hi)))"
    e = f"floor(log2(abs({column})))"
    size = f"CASE WHEN {column} = 0 THEN 0D ELSE signum({column}) * (1100 + {e} + abs({column}) / greatest(pow(2D, {e}), 4.9E-324D) - 1) END"
    return F.expr(f"CASE WHEN {alike} THEN {column} / 2 ELSE {size} END")


def exact_quantiles(samples: DataFrame, quantiles: list[float], value: str = "duration", by: str = "route") -> DataFrame:
    """(by, q, n, value): the value at place int(n * q) of each group's sorted values, whatever the size of the group.

    Selection by refined histograms: a round counts the values of each BINS-th of a target's range and keeps
    the one that holds its place, with the least and greatest value there. No more than BINS counts a
    target are gathered, from partial counts of every task; when a range is one value, or holds SMALL rows, it is done.
    Null groups, and values that are null or not finite, take no part.
    """
    rows = samples.select(F.col(by).alias("by"), F.col(value).cast("double").alias("v")).filter("by IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')")
    rows = checkpointed(rows)
    places = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    todo = rows.groupBy("by").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).select("by", places.alias("q"), "n", "lo", "hi")
    todo = checkpointed(todo.select("*", F.least(F.floor(F.col("n") * F.col("q")), F.col("n") - 1).alias("place"), F.col("n").alias("held")))
    done = []
    while True:
        open_ = (F.col("lo") < F.col("hi")) & (F.col("held") > SMALL)
        done.append(todo.filter(~open_))
        todo = todo.filter(open_)
        left = todo.count()
        if not left:
            break
        targets = F.broadcast(todo) if left <= FEW else todo
        at = F.least(F.floor((_scaled("v") - _scaled("lo")) / (_scaled("hi") - _scaled("lo")) * BINS), F.lit(BINS - 1)).cast("int")
        counted = rows.join(targets, "by").filter("v BETWEEN lo AND hi").groupBy("by", "q", "n", "place", at.alias("bin")).agg(F.count("*").alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("held").over(Window.partitionBy("by", "q").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))  # at most BINS rows a target
        kept = counted.withColumn("before", F.coalesce(before, F.lit(0))).filter("place >= before AND place < before + held")
        todo = checkpointed(kept.select("by", "q", "n", "lo", "hi", (F.col("place") - F.col("before")).alias("place"), "held"))
    ends = reduce(DataFrame.unionByName, done)
    one = ends.filter("lo = hi").select("by", "q", "n", F.col("lo").alias("v"))
    few = ends.filter("lo < hi")
    order = F.row_number().over(Window.partitionBy("by", "q").orderBy("v"))  # at most SMALL rows
    few = rows.join(F.broadcast(few) if few.count() <= FEW else few, "by").filter("v BETWEEN lo AND hi").withColumn("at", order - 1).filter("at = place").select("by", "q", "n", "v")
    return one.unionByName(few).withColumnsRenamed({"by": by, "v": value})


def _bucket(rate: float, burst: int):
    def run(key: tuple, groups: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(burst), None)
        for rows in groups:
            rows = rows.sort_values(["seconds", "id"])
            allowed = np.zeros(len(rows), dtype=bool)
            for k, now in enumerate(rows["seconds"].to_numpy()):
                tokens = min(float(burst), tokens + (0.0 if last is None else max(0.0, now - last)) * rate)
                allowed[k] = tokens >= 1.0
                tokens -= float(allowed[k])
                last = float(now)
            yield pd.DataFrame({"key": key[0], "id": rows["id"].to_numpy(), "allowed": allowed})
        state.update((tokens, last if last is not None else 0.0))

    return run


class _State:
    """The state of one key when all its rows are at hand."""

    exists, get = False, None

    def update(self, value) -> None:
        self.get = value


def token_bucket(requests: DataFrame, rate: float = 1.0, burst: int = 60) -> DataFrame:
    """requests (key, id, seconds) in order of time and id: whether a token was left. An ordered fold a key.

    A key's requests depend on all before them; they arrive sorted and are folded batch by
    batch, so memory is bounded by a batch and not by the key.
    """
    run = _bucket(rate, burst)

    def fold(batches):
        import pyarrow as pa

        key, state = None, None
        for batch in batches:
            df = batch.to_pandas()
            out = []
            for k, rows in df.groupby("key", sort=False):
                if k != key:
                    key, state = k, _State()
                out += list(run((k,), iter([rows]), state))
                state.exists = True
            if out:
                yield pa.RecordBatch.from_pandas(pd.concat(out), preserve_index=False)

    ordered = requests.select("key", "id", "seconds").repartition("key").sortWithinPartitions("key", "seconds", "id")
    return ordered.mapInArrow(fold, requests.select("key", "id").schema.add("allowed", "boolean"))
