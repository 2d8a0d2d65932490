"""Marts, the semantic layer, and the registered queries with their SQL."""

from . import contract_queries, event_queries, mart_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
