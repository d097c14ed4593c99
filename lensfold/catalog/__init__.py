"""All registered queries. Importing a module registers what it holds."""

from lensfold.catalog import filter_queries, join_queries, series_queries, sources_queries, vector_queries  # noqa: F401
from lensfold.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
