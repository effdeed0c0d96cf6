"""Registered queries, reports and the detection pipeline."""

from __future__ import annotations


def registered() -> tuple[dict, dict]:
    """All queries of the package's own operators, and the SQL of those that have it."""
    from . import fusion_queries, geometry_queries, more_queries, polygon_queries, report_queries, scalar_queries, table_queries  # noqa: F401
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
