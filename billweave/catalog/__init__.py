"""Queries on the given tables. Importing this package registers them."""

from billweave.catalog import anomaly_queries, cost_queries, insight_queries, storage_queries  # noqa: F401
from billweave.catalog.registry import QUERIES

__all__ = ["QUERIES"]
