"""What operators share that is no operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filled(template: str, *values: str | Column) -> Column:
    """A sentence whose gaps {} are filled in order, by columns or their names; null if any value is."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, text in zip(values, parts[1:], strict=True):
        out += [(F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(text)]
    return F.concat(*out)
