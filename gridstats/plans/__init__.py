"""Registered queries with their oracles."""

from gridstats.plans import aggregates, domain, joins, ordered, scan_project  # noqa: F401
from gridstats.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
