"""Queries over the test tables, each with the SQL that must give the same rows."""

from workload import model_queries, table_queries, timeline_queries  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
