"""All named queries."""

from quillon.plans import audit_queries, extract_queries, governance_queries, pool_queries, resolve_queries, search_queries, source_queries
from quillon.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "audit_queries", "extract_queries", "governance_queries", "pool_queries", "resolve_queries", "search_queries", "source_queries"]
