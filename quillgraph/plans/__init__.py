"""Registered queries."""

from quillgraph.plans import document_queries, graph_queries, search_queries, status_queries  # noqa: F401
from quillgraph.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
