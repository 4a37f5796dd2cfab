"""Queries of the llm operators over the driver's tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_texts
from tidemark.llm.consensus import Consensus
from tidemark.llm.islands import island_report, islands
from tidemark.llm.leaks import cleaned_texts, item_leaks
from tidemark.llm.nearest import nearest_of, similar_pairs
from tidemark.llm.plain_text import plain_forms
from tidemark.llm.spam_pages import page_scores, spam_pages
from tidemark.llm.termfreq import marked, term_frequency
from tidemark.session import spread, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "source_type"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_pairs(table(spark, sf_dir, "w4_records"), "article_id", "resonance_vector", "computed_at", 0.999)
    return pairs.select(F.col("a").alias("article_a"), F.col("b").alias("article_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = islands(table(spark, sf_dir, "w4_records"), "article_id", "resonance_vector", "computed_at", 0.70)
    return found.select(F.col("id").alias("article_id"), F.col("first").alias("island_first"))


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar articles of every fiftieth one (by hash of its id), against all."""
    asked = F.pmod(F.xxhash64("id"), F.lit(50)) == 0
    near = nearest_of(table(spark, sf_dir, "w4_records"), "article_id", "resonance_vector", "computed_at", 5, asked)
    return near.select(F.col("id").alias("article_id"), F.col("rank").cast("long").alias("rank"), "other", F.round("cosine", 6).alias("cosine"))


def p2_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = island_report(table(spark, sf_dir, "w4_records"), "article_id", "resonance_vector", "computed_at", 0.70)
    return r.select(F.col("first").alias("island_first"), "size", "cells", F.array_join("typical", "|").alias("typical"))


def _consensus(spark: SparkSession, sf_dir: str) -> Consensus:
    return Consensus(table(spark, sf_dir, "audit_votes_7cprime"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _consensus(spark, sf_dir).statuses().filter(F.col("annotators") >= 3)
    return items.select(F.col("item").alias("aggregate_key"), F.col("status").alias("status_suggestion"))


def p3_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _consensus(spark, sf_dir)
    named = {"item": "aggregate_key", "status": "status_suggestion", "volatility": "volatility_estimate", "review": "needs_human_review"}
    return c.items().withColumnsRenamed(named).withColumn("alpha", F.lit(c.alpha).cast("double"))


def p3_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).annotators().withColumnRenamed("annotator", "auditor_id")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(term_frequency(table(spark, sf_dir, "w2_records"), "token_norm", "emission_id", "count", "doc_freq"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).filter(F.col("mark").isNotNull()).select(F.col("term").alias("token_norm"), "mark")


def p5_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"term": "token_norm", "total": "total_count", "records": "total_doc_freq"}
    return _terms(spark, sf_dir).filter(F.col("term").isNotNull()).withColumnsRenamed(named)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_forms(table(spark, sf_dir, "w2_records"), "row_id", ["token_norm", "top_surface_form"])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_docs(spark, sf_dir), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_coverage(spark, sf_dir).select("doc_id", "item_id")


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_leaks(_docs(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_texts(_docs(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(_docs(spark, sf_dir), "doc_id", "text", "source", ["lang", "source_type"])


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_scores(_docs(spark, sf_dir), "doc_id", "text", "source", ["lang", "source_type"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_nearest": p1_nearest,
        "p2_found": p2_found,
        "p2_islands": p2_islands,
        "p3_found": p3_found,
        "p3_items": p3_items,
        "p3_annotators": p3_annotators,
        "p5_found": p5_found,
        "p5_frequency": p5_frequency,
        "p6_found": p6_found,
        "p7_ids": p7_ids,
        "p8_found": p8_found,
        "p8_coverage": p8_coverage,
        "p8_cleaned": p8_cleaned,
        "p9_found": p9_found,
        "p9_scores": p9_scores,
    }


_FREQ = """
with once as (select emission_id, any_value(token_norm) token_norm, any_value("count") c, any_value(doc_freq) d from w2_records where emission_id is not null group by 1
  union all select emission_id, token_norm, "count", doc_freq from w2_records where emission_id is null),
f as (select token_norm, count(*)::bigint emissions, coalesce(sum(c), 0)::bigint total_count, coalesce(sum(d), 0)::bigint total_doc_freq
  from once group by 1),
m as (select *, case when emissions >= 0.002 * (select sum(emissions) from f) then 'common' when total_doc_freq <= 2 then 'rare' end mark
  from f where token_norm is not null)"""


#: Cosines of all pairs of articles, by the latest vector of each.
_PAIRS = """
v as (select * from (select *, row_number() over (partition by article_id order by computed_at desc nulls last) k from w4_records where article_id is not null) where k = 1),
e as (select article_id, x.key d, x.value v from (select article_id, unnest(map_entries(resonance_vector)) x from v)),
f as (select * from e where v is not null and not isnan(v) and v <> 0), n as (select article_id, sqrt(sum(v * v)) n from f group by 1),
u as (select article_id, d, v / n v from f join n using (article_id)),
c as (select p.article_id a, q.article_id b, round(sum(p.v * q.v), 12) c from u p join u q on p.d = q.d and p.article_id < q.article_id group by 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_PAIRS} select a article_a, b article_b from c where c >= 0.999",
        "p2_found": f"""with recursive {_PAIRS}, l as (select a x, b y from c where c >= 0.7 union all select b, a from c where c >= 0.7),
r as (select article_id x, article_id y from n union select r.x, l.y from r join l on l.x = r.y),
g as (select x, min(y) f, count(*) size from r group by 1) select x article_id, f island_first from g where size >= 3""",
        "p5_found": f"{_FREQ} select token_norm, mark from m where mark is not null",
        "p5_frequency": f"{_FREQ} select * from m",
    }
