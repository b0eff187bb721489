"""Filter interaction audit over a packed bitmap index.

Every text is judged once by the filters that read it; its hash finds equal texts under smaller
ids. A task packs what it holds into bit sets: one a filter (its failures), one a label and one a part.
The documents that are left after a set of filters are the AND-NOT of their bit sets, so a filter's
effect after any prefix is a few words' AND and a popcount: a part's 2 ** n prefix sets stand for all
n! orders. Tasks send counts a (part, prefix set, filter), which are added up; the orders are read
off these sums.

Defined cases: a null text is empty; it has no words, fails `few_words`, and equals other empty
texts. Parts are the values of the part column, null as the empty string. Rows that share id and
text are each other's equals by id, so neither is the later one; a null id is no id: its text is neither
found under a smaller id nor the smaller id's, and no label is its. Labels of one id count if any row
has them. Texts are read whole, of any length. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, checkpointed, chunks_of, mix, text_struct

#: Filters in bit order; E is judged against the table, the others by the text.
FILTERS = "ABCDE"
#: The symbols of filter D.
SYMBOLS = b"#$%&*|"
LABELS = ("quality", "toxic")


def _flags(values) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


_UPPER, _SYMBOL = _flags(range(65, 91)), _flags(SYMBOLS)


def _distinct(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each text."""
    order = np.argsort(mix(keys ^ mix(text.astype(np.uint64))))
    key, who = keys[order], text[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (who[1:] != who[:-1]))) if len(key) else np.zeros(0, bool)
    return np.bincount(who[new], minlength=n)


def judge(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Failures of A to D as bits 1, 2, 4, 8."""
    out = []
    for s, e in chunks_of(texts):
        w = Words(texts[s:e])
        n = e - s
        per = lambda flags: np.add.reduceat(flags, w.text_starts, dtype=np.int64)  # noqa: E731, B023
        distinct = _distinct(w.hashes(), np.repeat(np.arange(n), w.counts), n)
        points = per((w.buffer & 0xC0) != 0x80) - 1  # but for the separator
        out.append((w.counts < 200) + 2 * (100 * distinct < 50 * w.counts) + 4 * (100 * per(_UPPER[w.buffer]) > 3 * points) + 8 * (per(_SYMBOL[w.buffer]) > 0))
    return {"failed": np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)}


def judged(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, failed, quality, toxic) of every document; failed has a bit a filter."""
    texts = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    # what is moved from here on is a few words a document, whatever its length
    rows = checkpointed(texts.select("doc_id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), text_struct(lambda: judge, "failed int")(F.col("text")).alias("bits")))
    # digests held by one id only need no look: partial minima and maxima leave little to shuffle of a hot text
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first")
    found = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(x) == 1).cast("int")), F.lit(0)).alias(x) for x in LABELS])
    out = rows.join(first, "digest", "left").join(found, "doc_id", "left")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return out.select("part", F.col("bits.failed").bitwiseOR(F.when(later, 16).otherwise(0)).alias("failed"), *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in LABELS])


COUNTS = ("removed", "left", "good_lost", "toxic_lost")
COUNTED = "part string, before int, filter int, " + ", ".join(f"{c} long" for c in COUNTS)


def _counted(batches):
    """Counts of each (part, set of filters before, filter) of a task's documents."""
    sums: dict[str, np.ndarray] = {}
    n = len(FILTERS)
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(0).dictionary_encode()
        part = names.indices.to_numpy(zero_copy_only=False)
        failed, good, toxic = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
        order = np.argsort(part, kind="stable")  # a part's documents side by side, so that its bit sets are short
        cuts = np.searchsorted(part[order], np.arange(len(names.dictionary) + 1))
        for name, s, e in zip(names.dictionary.to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            mine = order[s:e]
            fails = [np.packbits(failed[mine] >> f & 1) for f in range(n)]
            good_bits, toxic_bits = np.packbits(good[mine] == 1), np.packbits(toxic[mine] == 1)
            left = [np.packbits(np.ones(len(mine), dtype=bool))]
            for before in range(1, 1 << n):
                top = before.bit_length() - 1
                left.append(left[before ^ (1 << top)] & ~fails[top])
            sums.setdefault(name, np.zeros((1 << n, n, len(COUNTS)), dtype=np.int64))
            for before in range(1 << n):
                for f in range(n):
                    if not before >> f & 1:
                        gone = left[before] & fails[f]
                        sums[name][before, f] += [int(np.bitwise_count(x).sum(dtype=np.int64)) for x in (gone, left[before | 1 << f], gone & good_bits, gone & toxic_bits)]
    rows = [(name, before, f, *m[before, f].tolist()) for name, m in sums.items() for before in range(1 << n) for f in range(n) if not before >> f & 1]
    cols = list(zip(*rows)) if rows else [[]] * (3 + len(COUNTS))
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * len(COUNTS)]
    yield pa.record_batch({name: pa.array(c, k) for name, c, k in zip(("part", "before", "filter", *COUNTS), cols, kinds)})


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, set of filters before, filter) of all orders of the filters."""
    out = []
    for p in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in p)
        out += [(name, k + 1, sum(1 << f for f in p[:k]), f) for k, f in enumerate(p)]
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Per part, order of the filters and step: what the filter removes there, and how that compares with other orders."""
    spark = docs.sparkSession
    sums = judged(docs, labels, part).mapInArrow(_counted, COUNTED).groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS])
    # 600 rows, whatever the data
    steps = spark.createDataFrame(orders(), "filter_order string, step int, before int, filter int")
    times = steps.groupBy("before", "filter").agg(F.count("*").alias("times"))
    others = F.expr(f"{(1 << len(FILTERS)) - 1} - shiftleft(1, filter)")
    alone = sums.join(F.broadcast(times), ["before", "filter"]).groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("before") == others, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("times")).alias("shapley"),
    )
    return (
        sums.join(F.broadcast(steps), ["before", "filter"])
        .join(alone, ["part", "filter"])
        .select("part", "filter_order", "step", F.col("left").alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    )
