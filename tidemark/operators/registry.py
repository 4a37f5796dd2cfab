"""The registry of contexts: content-addressed, each stored once, and its queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.traces import namespace


def registered(contexts: DataFrame) -> DataFrame:
    """Each context_id once with its traces, retrieval_path and how often it came. Equal ids hold equal content."""
    v = F.struct("traces", "retrieval_path")
    return contexts.groupBy("context_id").agg(F.any_value(v).alias("v"), F.count(F.lit(1)).alias("times")).select("context_id", "v.*", "times")


def new_contexts(contexts: DataFrame, stored: DataFrame) -> DataFrame:
    """What an append would add: contexts whose id isn't stored yet."""
    return registered(contexts).join(stored.select("context_id"), "context_id", "left_anti")


def with_trace(registry: DataFrame, key: str, value: str | None) -> DataFrame:
    """Contexts whose trace equals ``value``; None also finds those that lack the trace."""
    return registry.filter(F.try_element_at("traces", F.lit(key)).eqNullSafe(F.lit(value)))


def with_namespace(registry: DataFrame, name: str) -> DataFrame:
    return registry.filter(F.exists(F.map_keys("traces"), lambda k: k.startswith(f"{name}:")))


def namespace_summary(registry: DataFrame) -> DataFrame:
    """namespace, contexts: each context counted once per namespace."""
    n = F.array_distinct(F.transform(F.map_keys("traces"), namespace))
    return registry.select(F.explode(n).alias("namespace")).groupBy("namespace").agg(F.count(F.lit(1)).alias("contexts"))


def verified(registry: DataFrame, recomputed: Column) -> DataFrame:
    """Contexts whose id doesn't follow from their content."""
    return registry.filter(~F.col("context_id").eqNullSafe(recomputed))
