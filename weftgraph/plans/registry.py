"""Registered queries: a function of (spark, sf_dir), and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.starschema import PRELUDE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, prelude: bool = True, recursive: bool = False):
    """Register a query; `sql` may use the prelude's tables (sym, edge, dep, blame)."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            start = f"WITH {'RECURSIVE ' if recursive else ''}{PRELUDE}" if prelude else ""
            body = sql.strip()
            if prelude and body[:5].upper() == "WITH ":
                body = "," + body[5:]
            ORACLES[key] = start + body
        return f

    return add
