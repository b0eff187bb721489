"""Joins on substrings: which names hold a reference, by trigrams instead of comparing all with all.

A reference of three characters or more is looked up by that of its trigrams which the fewest
names have, so a common trigram multiplies only where a reference has no rarer one; shorter ones
are looked up as they are. The candidates are then compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import checkpointed

SIZES = (1, 2, 3)


def grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    return F.filter(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))), lambda g: F.length(g) == n)


@dataclass(frozen=True)
class NameIndex:
    """(gram, name) of every name, and how many names have each gram."""

    held: DataFrame
    counts: DataFrame


def name_index(names: DataFrame) -> NameIndex:
    """The index of distinct names (name), computed once; null and empty names are left out."""
    names = names.select("name").filter("name <> ''").distinct()
    held = checkpointed(names.select("name", F.explode(F.concat(*[grams(F.col("name"), n) for n in SIZES])).alias("gram")))
    return NameIndex(held, checkpointed(held.groupBy("gram").agg(F.count("*").alias("n"))))


def holders(refs: DataFrame, index: NameIndex) -> DataFrame:
    """(ref, name): every indexed name that is a ref (ref) or holds it. Null and empty refs are in none."""
    refs = refs.select("ref").filter("ref <> ''").distinct()
    cut = F.when(F.length("ref") >= SIZES[-1], grams(F.col("ref"), SIZES[-1])).otherwise(F.array("ref"))
    # a gram that no name has settles the ref
    keyed = refs.select("ref", F.explode(cut).alias("gram")).join(index.counts, "gram", "left").na.fill(0, ["n"])
    rarest = keyed.groupBy("ref").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.min("n").alias("n")).filter("n > 0").drop("n")
    return rarest.join(index.held, "gram").filter(F.contains(F.col("name"), F.col("ref"))).select("ref", "name")
