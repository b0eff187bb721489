"""Registered queries and their SQL."""

from . import account_queries, graph_queries, other_queries, search_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
