"""Registry of the queries over the driver's tables, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import audit_queries, event_queries, file_queries, graph_queries, island_queries, lookup_queries, registry_queries, segment_queries, skew_queries, stats_queries, summary_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [skew_queries, text_queries, segment_queries, stats_queries, island_queries, event_queries, registry_queries, audit_queries, graph_queries, lookup_queries, summary_queries, file_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characteristic tokens of each condition."""
    return queries()["w3_specific_tokens"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
