"""Queries of the text functions over whole documents. Long results are given as counts and digests of the content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.stats import token_rows
from tidemark.plans.text_sql import CJK_SQL, RUN_SQL, STOP_SQL, WORD_SQL, bigrams, lit, norm, raw_tokens
from tidemark.session import spread, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _listed(make) -> object:
    """Query giving doc_id, n and the digest of a list of words made from each text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = _docs(spark, sf_dir).select("doc_id", make(F.col("text")).alias("w"))
        return d.filter(F.col("w").isNotNull()).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))

    return run


def _listed_sql(expr: str) -> str:
    return f"select doc_id, len(w)::bigint n, md5(array_to_string(w, ' ')) digest from (select doc_id, {expr} w from documents where text is not null)"


def f5_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = token_rows(_docs(spark, sf_dir), "doc_id", "text", valid=False)
    g = t.groupBy("surface").agg(F.any_value("token").alias("token"), F.count(F.lit(1)).alias("n"), F.sum(F.col("first").cast("long")).alias("_"))
    return g.select("surface", "token", T.valid_token(F.col("token")).alias("valid"), "n")


def wn11_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _docs(spark, sf_dir).filter(F.col("text").isNotNull()).select("doc_id", T.plain_words(F.col("text")).alias("p"))
    g = w.select("doc_id", T.ngrams(F.col("p"), 2, 5).alias("w"))
    return g.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


def _kept(words: Column) -> Column:
    return F.filter(words, lambda w: ~T.is_noise(w))


def f12_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct word of the corpus that may be a slip of a reference word, with the nearest one and up to three by confidence."""
    from tidemark.operators.words import typo_candidates

    words = _docs(spark, sf_dir).select(F.explode(F.array_distinct(T.plain_words(F.col("text")))).alias("word")).distinct()
    return typo_candidates(words, "word")


_PLAIN = r"""list_filter([regexp_replace(w, '^''+|''+$', '', 'g') for w in regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9''\s]', ' ', 'g'), '\s+')], lambda w: w <> '')"""
_NGRAMS = " || ".join(f"(case when len(p) >= {n} then [array_to_string(p[i:i+{n - 1}], ' ') for i in range(1, len(p) - {n - 2})] else [] end)" for n in range(2, 6))
_HYBRID = f"flatten([case when ord(r) > 127 then {bigrams('r')} else [r] end for r in regexp_extract_all(text, {RUN_SQL})])"

QUERIES = {
    "f1_english_tokens": _listed(T.english_tokens),
    "f2_cjk_bigrams": _listed(T.cjk_bigrams),
    "f3_hybrid_tokens": _listed(T.hybrid_tokens),
    "f5_normalized": f5_normalized,
    "f6_plain_words": _listed(T.plain_words),
    "f7_sensor_words": _listed(T.sensor_words),
    "f8_trigger_words": _listed(T.trigger_words),
    "p22_content_words": _listed(lambda c: _kept(T.plain_words(c))),
    "wn11_ngrams": wn11_ngrams,
    "f12_typos": f12_typos,
}
_WORDS = "[" + ", ".join(map(lit, sorted(T.TYPO_WORDS))) + "]"
SQL = {
    "f1_english_tokens": _listed_sql(f"regexp_extract_all(text, {WORD_SQL})"),
    "f2_cjk_bigrams": _listed_sql(f"flatten([{bigrams('r')} for r in regexp_extract_all(text, {CJK_SQL})])"),
    "f3_hybrid_tokens": _listed_sql(_HYBRID),
    "f5_normalized": rf"""with {raw_tokens('documents', 'doc_id')}
select surface, any_value(token) token, regexp_matches(any_value(token), '[\p{{L}}\p{{N}}]') valid, count(*)::bigint n
from (select surface, {norm('surface')} token from raw) where token is not null group by surface""",
    "f6_plain_words": _listed_sql(_PLAIN),
    "f7_sensor_words": _listed_sql(f"list_filter({_PLAIN}, lambda w: length(w) >= 2)"),
    "f8_trigger_words": _listed_sql("regexp_extract_all(lower(text), '[a-z]+')"),
    "p22_content_words": _listed_sql(f"list_filter({_PLAIN}, lambda w: length(w) >= 2 and w not in ({STOP_SQL}))"),
    "wn11_ngrams": f"select doc_id, len(w)::bigint n, md5(array_to_string(w, ' ')) digest from (select doc_id, {_NGRAMS} w from (select doc_id, {_PLAIN} p from documents where text is not null))",
    "f12_typos": f"""with v as (select distinct unnest({_PLAIN}) word from documents where text is not null),
d as (select word, r, levenshtein(word, r) d, abs(length(word) - length(r)) g, greatest(length(word), length(r)) m from v, (select unnest({_WORDS}) r) where length(word) >= 3),
c as (select *, case when d = 1 and g <= 1 then 0.85 - 0.1 * g else (1 - d / 3.0) * (1 - g / m) end conf from d where d between 1 and 2),
k as (select *, row_number() over (partition by word order by d, r) best, row_number() over (partition by word order by round(conf::double, 9) desc, r) nth from c)
select word, case when max(case when best = 1 then conf end) >= 0.7 then max(case when best = 1 then r end) end suggestion,
  min(d)::bigint distance, round(max(case when best = 1 then conf end)::double, 3) confidence,
  case when length(word) <= 6 then string_agg(r, '|' order by nth) filter (nth <= 3) else '' end candidates from k group by word""",
}
