"""Traces: typed facts under ``namespace:name`` keys, their validity and normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces and names that judge instead of stating a fact, and keys allowed all the same.
FORBIDDEN_NAMESPACES = ("meaning", "category", "intent", "quality", "importance", "sentiment", "topic", "type")
FORBIDDEN_NAMES = (
    "source_type content_type_semantic document_type media_type_semantic is_short is_long is_formal is_informal is_news "
    "is_social is_spam is_valid is_important is_relevant quality_score sentiment_score importance_score relevance_score "
    "readability_score classified_as labeled_as detected_as inferred_type"
).split()
ALLOWED_KEYS = ("legacy:source_type", "legacy:language_profile", "meta:content_type")
TEXT_MOST, INT_LOW, INT_HIGH, PLACES = 4096, -(2**31), 2**31 - 1, 9


def key_error(key: Column) -> Column:
    """Why a trace key isn't valid (null where it is); a null key is no key."""
    parts = F.split(key, ":")
    space, name = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return (
        F.when(key.isNull(), "not_text")
        .when(~key.contains(":"), "no_separator")
        .when(F.size(parts) != 2, "many_separators")
        .when(space == "", "empty_namespace")
        .when(name == "", "empty_name")
        .when(space.isin(*FORBIDDEN_NAMESPACES), "forbidden_namespace")
        .when(name.isin(*FORBIDDEN_NAMES) & ~key.isin(*ALLOWED_KEYS), "forbidden_name")
        .when(~key.rlike("^[a-z][a-z0-9_]*:[a-z][a-z0-9_]*$"), "characters")
    )


def text_error(value: Column) -> Column:
    return F.when(F.length(value) > TEXT_MOST, "too_long")


def float_error(value: Column) -> Column:
    return F.when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), "infinite")


def int_error(value: Column) -> Column:
    return F.when((value < INT_LOW) | (value > INT_HIGH), "out_of_range")


def map_errors(traces: Column) -> Column:
    """All errors of a map of texts as sorted ``key=error`` strings."""
    errors = F.transform(F.map_entries(traces), lambda e: F.coalesce(key_error(e["key"]), text_error(e["value"])))
    pairs = F.zip_with(F.map_keys(traces), errors, lambda k, e: F.when(e.isNotNull(), F.concat(k, F.lit("="), e)))
    return F.sort_array(F.filter(pairs, lambda x: x.isNotNull()))


def normal_float(value: Column) -> Column:
    return F.round(value, PLACES)


def normal_int(value: Column) -> Column:
    return F.greatest(F.lit(INT_LOW), F.least(F.lit(INT_HIGH), value))


def normal_text(value: Column) -> Column:
    """A text as stored among traces; longer ones are cut there."""
    return F.left(value, F.lit(TEXT_MOST))


def normal_map(traces: Column) -> Column:
    """Traces in key order with normal values; an error of any key or value is raised."""
    bad = map_errors(traces)
    entries = F.transform(F.sort_array(F.map_entries(traces)), lambda e: F.struct(e["key"].alias("key"), normal_text(e["value"]).alias("value")))
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("traces not valid: "), F.array_join(bad, ", ")))).otherwise(F.map_from_entries(entries))


def namespace(key: Column) -> Column:
    return F.split_part(key, F.lit(":"), F.lit(1))


def in_namespace(traces: Column, name: str) -> Column:
    return F.map_filter(traces, lambda k, v: k.startswith(f"{name}:"))
