"""Registered queries and, beside each, the SQL that gives the same rows."""

from . import chunks, evaluation, training  # noqa: F401
from .register import ORACLE_SQL, QUERIES

FLAGSHIP = "bm25_metrics"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
