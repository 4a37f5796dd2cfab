"""Queries of the segmenters over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.spans import SPACE
from tidemark.operators import segment as G
from tidemark.plans.text_sql import RUN_SQL, lit
from tidemark.session import spread, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _rows(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = G.segmenter(name)(_docs(spark, sf_dir), "text").withColumn("f", G.segment_facts(F.col("segment")))
        return s.select(
            "doc_id",
            F.col("start").cast("long").alias("start"),
            F.col("end").cast("long").alias("end"),
            F.col("f.char_count").cast("long").alias("char_count"),
            F.col("f.token_count").cast("long").alias("token_count"),
            F.col("f.has_punctuation").alias("has_punctuation"),
            F.md5("segment").alias("digest"),
        )

    return run


def p07_empty_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without any segment, and why."""
    f = G.segment_facts(F.coalesce("text", F.lit("")))
    d = _docs(spark, sf_dir).withColumn("f", f)
    return d.filter("f.empty").select("doc_id", F.when(F.col("text").isNull(), "null_text").when(F.col("text") == "", "empty_text").otherwise("blank_text").alias("diagnostic"))


def f3_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = G.token_spans(_docs(spark, sf_dir), "text")
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("start").cast("long")).alias("starts"), F.sum(F.col("end").cast("long")).alias("ends"))


def p09_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    once = G.prefixed_source(F.col("source"), "D")
    return d.select("doc_id", once.alias("source_id"), G.prefixed_source(once, "A").alias("again"))


QUERIES = {
    "p01_sentences": _rows("sentence"),
    "p03_paragraphs": _rows("paragraph"),
    "p04_sentences_in_paragraphs": _rows("hybrid"),
    "p07_empty_texts": p07_empty_texts,
    "f3_token_spans": f3_token_spans,
    "p09_sources": p09_sources,
}
_S = SPACE.replace(r"\x85", r"\x{85}")
_BREAK = lit(rf"\n{_S}*\n")
_EDGE = lambda c: f"regexp_replace(regexp_replace({c}, {lit(f'^{_S}+')}, ''), {lit(_S + '+$')}, '')"
SQL = {
    "p03_paragraphs": rf"""with x as (select doc_id, text, regexp_split_to_array(text, {_BREAK}) p, regexp_extract_all(text, {_BREAK}) g from documents where text is not null),
y as (select doc_id, unnest(p) p, unnest(g || ['']) g, unnest(range(len(p))) i from x),
z as (select doc_id, i, p, sum(length(p) + length(g)) over (partition by doc_id order by i) - length(p) - length(g) base, {_EDGE('p')} s, length(p) - length(regexp_replace(p, {lit(f'^{_S}+')}, '')) lead from y)
select doc_id, (base + lead)::bigint "start", (base + lead + length(s))::bigint "end", length(s)::bigint char_count,
  len(list_filter(regexp_split_to_array(s, {lit(_S + '+')}), lambda w: w <> ''))::bigint token_count, regexp_matches(s, '[.!?]') has_punctuation, md5(s) digest from z where length(s) >= 10""",
    "p07_empty_texts": f"""select doc_id, case when text is null then 'null_text' when text = '' then 'empty_text' else 'blank_text' end diagnostic from documents
where coalesce({_EDGE('text')}, '') = ''""",
    "f3_token_spans": f"""with x as (select doc_id, regexp_split_to_array(text, {RUN_SQL}) g, regexp_extract_all(text, {RUN_SQL}) r from documents where text is not null),
y as (select doc_id, unnest(r) r, unnest(g[:len(r)]) g, unnest(range(len(r))) i from x),
z as (select doc_id, r, sum(length(g) + length(r)) over (partition by doc_id order by i) - length(r) a, case when ord(r) > 127 and length(r) > 1 then length(r) - 1 else 1 end m from y)
select doc_id, sum(m)::bigint n, sum(m * a + m * (m - 1) / 2)::bigint starts, sum(case when ord(r) > 127 and length(r) > 1 then m * a + m * (m - 1) / 2 + 2 * m else a + length(r) end)::bigint ends from z group by 1""",
    "p09_sources": "select doc_id, case when regexp_matches(source, '^[AD]:') then source else 'D:' || source end source_id, case when regexp_matches(source, '^[AD]:') then source else 'D:' || source end again from documents",
}
