"""The registered queries over the given tables and the SQL they are compared with."""

from __future__ import annotations

from scoreloom.plans import analytics, runs, scoring, tables
from scoreloom.plans.registry import ORACLES, QUERIES

__all__ = ["analytics", "oracle_sql", "queries", "runs", "scoring", "tables"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
