"""All queries of the library, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from linkfold.plans import analog_queries, label_queries, log_queries, queries, scan_queries  # noqa: F401  (registering)
from linkfold.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
