"""Registered queries over the driver's tables, with their SQL."""

from . import analytics_queries, contract_queries, landed_queries, search_queries, source_queries, upkeep_queries  # noqa: F401  each registers its queries
