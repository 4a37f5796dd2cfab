"""Conditions of articles: legacy factors, traces of the source data, and policies that sign chosen traces."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.canonical import digest, json_map, legacy_signature, policy_signature, quoted

# What the two legacy factors may say; anything else counts as unknown.
SOURCE_TYPES = ("news", "dialog", "paper", "social", "unknown")
LANGUAGES = ("en", "ja", "mixed", "unknown")


def current_articles(articles: DataFrame) -> DataFrame:
    """The latest row of each article (ties by url, then by context)."""
    order = F.struct("ingestion_time", F.coalesce("source_url", F.lit("")), F.coalesce("substrate_ref", F.lit("")))
    v = F.struct("source_url", "source_meta", "substrate_ref", "ingestion_time", "doc_id")
    return articles.groupBy("article_id").agg(F.max_by(v, order).alias("v")).select("article_id", "v.*")


def month(ts: Column) -> Column:
    """Month of a timestamp as YYYY-MM (null stays null)."""
    return F.date_format(ts, "yyyy-MM")


def known(value: Column, allowed: Sequence[str]) -> Column:
    return F.when(value.isin(*allowed), value).otherwise("unknown")


def with_legacy_condition(articles: DataFrame, time_col: str = "ingestion_time") -> DataFrame:
    """Adds source_type, language_profile, time_bucket and cond, their signature."""
    meta = F.col("source_meta")
    a = articles.withColumns(
        {
            "source_type": known(F.try_element_at(meta, F.lit("source_type")), SOURCE_TYPES),
            "language_profile": known(F.try_element_at(meta, F.lit("language_profile")), LANGUAGES),
            "time_bucket": month(F.col(time_col)),
        }
    )
    return a.withColumn("cond", legacy_signature(F.col("source_type"), F.col("language_profile"), F.col("time_bucket")))


def traces_of(meta: Column, url: Column | None = None) -> Column:
    """Traces of the source data: keys in lower case under ``legacy:``, null values left out, the url as a trace of its own.

    Two keys that fall together keep the value of the last in key order.
    """
    entries = F.sort_array(F.filter(F.map_entries(F.coalesce(meta, F.expr("cast(map() as map<string,string>)"))), lambda e: e["value"].isNotNull()))
    keyed = F.transform(entries, lambda e: F.struct(F.concat(F.lit("legacy:"), F.lower(e["key"])).alias("key"), e["value"].alias("value")))
    if url is not None:
        keyed = F.concat(keyed, F.when(url.isNotNull(), F.array(F.struct(F.lit("meta:retrieval_url").alias("key"), url.alias("value")))).otherwise(F.expr("cast(array() as array<struct<key:string,value:string>>)")))
    # The later of two equal keys wins.
    once = F.filter(keyed, lambda e, i: ~F.exists(F.slice(keyed, i + 2, F.size(keyed)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(once)


def context_id(traces: Column, url: Column, version: str = "v1") -> Column:
    """Content id of a context (its traces are strings): canonical JSON, 32 characters."""
    body = F.concat(F.lit('{"capture_version":'), quoted(F.lit(version)), F.lit(',"retrieval_path":'), quoted(url), F.lit(',"traces":'), json_map(traces), F.lit("}"))
    return digest(body, 32)


@dataclass(frozen=True)
class ConditionPolicy:
    """Signs the traces named by ``target_keys``; a missing trace is listed, never filled in. Subclass for other rules."""

    policy_id: str
    target_keys: tuple[str, ...]
    version: str = "v1.0"

    def factors(self, traces: Column) -> Column:
        return F.map_filter(traces, lambda k, v: k.isin(*self.target_keys))

    def missing(self, traces: Column) -> Column:
        return F.filter(F.array(*[F.lit(k) for k in sorted(self.target_keys)]), lambda k: ~F.array_contains(F.map_keys(traces), k))

    def signature(self, traces: Column) -> Column:
        return policy_signature(self.policy_id, self.version, json_map(self.factors(traces)), self.missing(traces))


POLICIES = {
    "standard": ConditionPolicy("standard", ("legacy:source_type", "legacy:language_profile")),
    "legacy_migration": ConditionPolicy("legacy_migration", ("legacy:source_type", "legacy:language_profile")),
    "source_only": ConditionPolicy("source_only", ("legacy:source_type",)),
    "language_only": ConditionPolicy("language_only", ("legacy:language_profile",)),
}


def with_policy_condition(articles: DataFrame, policy: ConditionPolicy, referenced: bool = True) -> DataFrame:
    """Adds cond: the policy's signature where the article names a context, else the legacy one.

    Without ``referenced`` every article is signed by the policy, its own traces being its context.
    """
    a = with_legacy_condition(articles).withColumn("_t", traces_of(F.col("source_meta"), F.col("source_url")))
    signed = policy.signature(F.col("_t"))
    return a.withColumn("cond", F.when(F.col("substrate_ref").isNotNull(), signed).otherwise(F.col("cond")) if referenced else signed).drop("_t")
