"""All queries over the reference-style operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.plans import catalog_queries, market_queries, rule_queries, sky_queries, table_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "k10_risk_scores"

for _module in (market_queries, sky_queries, table_queries, catalog_queries, rule_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.SQL
