"""All registered queries."""

from . import queries, queries_anchors, queries_enrichment, queries_functions, queries_graphs, queries_reports, queries_rules, queries_slices, queries_sql  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
