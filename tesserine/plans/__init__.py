"""Registered queries over the test tables."""

from . import graph_queries, paper_queries, record_queries, source_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
