"""Registered queries: every operator over the driver's tables, with its SQL twin.

``QUERIES[name]`` takes (spark, folder); ``SQL[name]`` is the same result in DuckDB's dialect.
Iterative learners have no SQL twin; the tests check their invariants.
"""

from threshcast.catalogue import charting, cleaning, evaluation, joining, learning, matrices
from threshcast.catalogue import past, quantile, storage
from threshcast.catalogue.base import QUERIES, SQL

__all__ = [
    "QUERIES",
    "SQL",
    "charting",
    "cleaning",
    "evaluation",
    "joining",
    "learning",
    "matrices",
    "past",
    "quantile",
    "storage",
]
