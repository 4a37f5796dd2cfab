"""Queries of the token statistics: global, per condition, specific tokens and resonance, over articles and their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canonical import old_signature, record_id
from tidemark.operators import stats as S
from tidemark.operators.conditions import POLICIES, context_id, current_articles, traces_of, with_legacy_condition, with_policy_condition
from tidemark.plans.text_sql import LEGACY, POLICY, SIGNED, norm, tokens
from tidemark.session import spread, table, written


def _tokens(spark: SparkSession, sf_dir: str, valid: bool = True) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").filter(F.col("article_id").isNotNull()).select("article_id", "text", "published_at"))
    return S.token_rows(d.withColumnRenamed("published_at", "ts"), "article_id", "text", "ts", valid=valid)


def a1_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S.global_stats(_tokens(spark, sf_dir), "article_id")
    return g.withColumns({"entropy": F.round("entropy", 6), "first_seen": F.unix_micros("first_seen"), "last_seen": F.unix_micros("last_seen")}).withColumnRenamed("token", "token_norm")


def a2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens read and counted over the corpus; every number adds up per article, so one small row per task is shuffled."""
    from tidemark.functions.text import hybrid_tokens, normalized, valid_token

    d = spread(table(spark, sf_dir, "documents").filter(F.col("article_id").isNotNull()).select("text")).select(hybrid_tokens(F.col("text")).alias("t"))
    n = F.size(F.filter("t", lambda s: valid_token(normalized(s))))
    return d.agg(F.count(F.lit(1)).alias("articles"), F.sum(F.size("t").cast("long")).alias("raw_tokens"), F.sum(n.cast("long")).alias("valid_tokens"))


def a3_surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.capped_forms(_tokens(spark, sf_dir), "article_id").select(F.col("token").alias("token_norm"), "form", "n")


def a52_top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent and the ten most varied tokens of the global statistics."""
    g = written(a1_token_stats(spark, sf_dir).select("token_norm", "total_count", "entropy"), "stats")
    by_count = g.orderBy(F.desc("total_count"), "token_norm").limit(10).withColumn("by", F.lit("count"))
    by_entropy = g.orderBy(F.desc("entropy"), "token_norm").limit(10).withColumn("by", F.lit("entropy"))
    return by_count.unionByName(by_entropy)


def _under(spark: SparkSession, sf_dir: str, conditioned: DataFrame, valid: bool = True) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("article_id", "text")
    return S.token_rows(conditioned.select("article_id", "cond").join(spread(d), "article_id"), "article_id", "text", "cond", valid=valid)


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_legacy_condition(current_articles(table(spark, sf_dir, "articles")))


def _policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_policy_condition(current_articles(table(spark, sf_dir, "articles")), POLICIES["standard"])


def p17_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of the legacy conditions with their denominators: tokens counted and articles."""
    a = _legacy(spark, sf_dir)
    docs = a.groupBy("cond", "source_type", "language_profile", "time_bucket").agg(F.count(F.lit(1)).alias("total_doc_count"))
    toks = _under(spark, sf_dir, a).groupBy("cond").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(toks, "cond", "left").select("cond", "source_type", "language_profile", "time_bucket", "total_doc_count", F.coalesce("n", F.lit(0).cast("long")).alias("total_token_count"))


def p19_policy_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per article its traces' context, the policy's missing keys and the signature in force."""
    a = _policy(spark, sf_dir).withColumn("t", traces_of(F.col("source_meta"), F.col("source_url")))
    missing = F.array_join(POLICIES["standard"].missing(F.col("t")), "|")
    return a.select("article_id", "cond", missing.alias("missing"), F.size(F.map_keys("t")).cast("long").alias("n_traces"), context_id(F.col("t"), F.col("source_url")).alias("context_id"))


def a5_condition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S.condition_stats(_under(spark, sf_dir, _legacy(spark, sf_dir)), "article_id")
    return g.select(record_id(F.col("token"), F.col("cond")).alias("record_id"), F.col("token").alias("token_norm"), "cond", "count", "doc_freq", F.round("entropy", 6).alias("entropy"), "top_form")


def a53_records_per_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _under(spark, sf_dir, _legacy(spark, sf_dir))
    return t.groupBy("token", "cond").count().groupBy("cond").agg(F.count(F.lit(1)).alias("records"), F.sum("count").alias("tokens"))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_policy_condition(current_articles(table(spark, sf_dir, "articles")), POLICIES["standard"], referenced=False)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _under(spark, sf_dir, _signed(spark, sf_dir))
    return S.scored(t.withColumn("count", F.lit(1).cast("long")))


def w3_specific_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characteristic tokens of each condition, most and least specific, with their scores."""
    top = S.specific_tokens(_scores(spark, sf_dir))
    return top.select("cond", "side", F.col("rank").cast("long").alias("rank"), F.col("token").alias("token_norm"), F.round("s", 9).alias("s_score"), "count", "count_all")


def a54_specificity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.specificity_summary(_scores(spark, sf_dir))


def w4_resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles projected on the conditions of the specific tokens: one row per article and condition that its tokens meet."""
    top = S.specific_tokens(_scores(spark, sf_dir))
    long = S.resonance(_under(spark, sf_dir, _signed(spark, sf_dir), valid=False).drop("cond"), top, "article_id")
    return long.select("article_id", "cond", F.round("r", 6).alias("r"))


def w3_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specific tokens from stored partial records: each emission once, its counts added up (nulls count nothing)."""
    top = S.specific_tokens(S.scored(stored_counts(spark, sf_dir)))
    return top.select("cond", "side", F.col("rank").cast("long").alias("rank"), F.col("token").alias("token_norm"), F.round("s", 9).alias("s_score"), "count", "count_all")


def stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "w2_records").filter(F.col("token_norm").isNotNull() & F.col("condition_signature").isNotNull() & F.col("count").isNotNull())
    once = r.groupBy("emission_id").agg(F.any_value(F.struct("token_norm", "condition_signature", "count")).alias("v"))
    return once.groupBy(F.col("v.token_norm").alias("token"), F.col("v.condition_signature").alias("cond")).agg(F.sum("v.count").alias("count"))


def f22_condition_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored conditions with the earlier signature of their factors."""
    c = table(spark, sf_dir, "w2_conditions")
    return c.select("signature", old_signature(F.col("factors")).alias("old_signature"), (old_signature(F.col("factors")) == F.col("signature")).alias("same"))


def f14_record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored record with its id made again from token and condition, to tell those that don't match."""
    r = table(spark, sf_dir, "w2_records")
    again = record_id(F.col("token_norm"), F.col("condition_signature"))
    return r.select("row_id", again.alias("record_id"), (again == F.col("record_id")).alias("same"))


QUERIES = {
    "a1_token_stats": a1_token_stats,
    "a2_totals": a2_totals,
    "a3_surface_forms": a3_surface_forms,
    "a52_top_tokens": a52_top_tokens,
    "p17_conditions": p17_conditions,
    "p19_policy_signatures": p19_policy_signatures,
    "a5_condition_stats": a5_condition_stats,
    "a53_records_per_condition": a53_records_per_condition,
    "w3_specific_tokens": w3_specific_tokens,
    "a54_specificity_summary": a54_specificity_summary,
    "w4_resonance": w4_resonance,
    "w3_of_records": w3_of_records,
    "f22_condition_ids": f22_condition_ids,
    "f14_record_ids": f14_record_ids,
}

_DOC = "dt as (select article_id, text, epoch_us(published_at) ts from documents where article_id is not null)"
_ENT = "case when sum(n) < 2 or count(*) < 2 then 0.0 else round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) end"
_FORMS = f"""with {_DOC}, {tokens('dt', 'article_id, ts')},
f0 as (select token, case when length(surface) > 50 then '__LONG__' else surface end form, count(*) n, min((article_id, pos)) seen, count(distinct article_id) docs, min(ts) lo, max(ts) hi from tok group by 1, 2),
f1 as (select *, row_number() over (partition by token, form = '__LONG__' order by seen) k from f0),
f2 as (select token, case when form = '__LONG__' or k <= 50 then form else '__OTHER__' end form, sum(n)::bigint n, min(seen) seen from f1 group by 1, 2),
src as (select token, arg_min(article_id, (-coalesce(ts, -4611686018427387904), article_id)) last_source, min(ts) first_seen, max(ts) last_seen, count(distinct article_id)::bigint document_frequency from tok group by 1),
ff as (select token, arg_min(form, (-n, seen)) filter (form not in ('__OTHER__', '__LONG__')) top_form, sum(n)::bigint total_count, count(*)::bigint n_forms, {_ENT} entropy from f2 group by 1)"""
_W1 = "select token token_norm, total_count, document_frequency, n_forms, top_form, first_seen, last_seen, last_source, entropy from ff join src using (token)"


def _joined(conditions: str, source: str, valid: bool = True) -> str:
    return f"""{conditions}, ct as (select c.article_id, c.cond, d.text from {source} c join documents d using (article_id)), {tokens('ct', 'article_id, cond', valid)}"""


_SCORED = """
pt as (select token, cond, sum(c)::bigint c from cnt group by 1, 2),
st as (select *, sum(c) over (partition by token) ca, sum(c) over (partition by cond) t, sum(c) over () ta from pt),
sc as (select cond, token, c, ca::bigint ca, (c / t) * ln((c / t + 1e-12) / (ca / ta + 1e-12)) s from st where not (c < 2 and ca < 2)),
tp as (select *, row_number() over (partition by cond, s > 0 order by abs(s) desc, token) k from sc where s <> 0),
top as (select * from tp where k <= 100)"""
_OF_TEXT = f"with {_joined(SIGNED, 'pol')}, cnt as (select token, cond, count(*) c from tok group by 1, 2), {_SCORED}"
_OF_RECORDS = f"""with one as (select emission_id, any_value(token_norm) token, any_value(condition_signature) cond, any_value("count") c from w2_records
  where token_norm is not null and condition_signature is not null and "count" is not null group by 1), cnt as (select token, cond, c from one), {_SCORED}"""
_TOP = "select cond, case when s > 0 then 'positive' else 'negative' end side, k::bigint \"rank\", token token_norm, round(s, 9) s_score, c \"count\", ca count_all from top"
_RECORD_ID = "left(sha256(concat('{\"cond\": ', {c}, ', \"token_norm\": ', {t}, '}')), 32)"
_rid = lambda t, c: _RECORD_ID.replace("{c}", f"coalesce(to_json({c})::varchar, 'null')").replace("{t}", f"coalesce(to_json({t})::varchar, 'null')")
SQL = {
    "a1_token_stats": f"{_FORMS} {_W1}",
    "a2_totals": f"""with {_DOC}, {tokens('dt', 'article_id')}
select (select count(*) from dt)::bigint articles, (select count(*) from raw)::bigint raw_tokens, (select count(*) from tok)::bigint valid_tokens""",
    "a3_surface_forms": f"{_FORMS} select token token_norm, form, n from f2",
    "a52_top_tokens": f"""{_FORMS}, w as ({_W1})
select * from (select token_norm, total_count, entropy, 'count' "by" from w order by total_count desc, token_norm limit 10)
union all select * from (select token_norm, total_count, entropy, 'entropy' "by" from w order by entropy desc, token_norm limit 10)""",
    "p17_conditions": f"""with {_joined(LEGACY, 'leg')}, n as (select cond, count(*)::bigint n from tok group by 1)
select cond, source_type, language_profile, time_bucket, count(*)::bigint total_doc_count, coalesce(any_value(n.n), 0)::bigint total_token_count
from leg left join n using (cond) group by 1, 2, 3, 4""",
    "p19_policy_signatures": f"""with {POLICY}, tt as (select article_id, count(*) n, string_agg(to_json(tkey)::varchar || ':' || to_json(tval)::varchar, ',' order by tkey) b from ent2 group by 1)
select p.article_id, p.cond, array_to_string(list_filter(['legacy:language_profile', 'legacy:source_type'], lambda k: not list_contains(p.tk, k)), '|') missing,
  coalesce(n, 0)::bigint n_traces, left(sha256(concat('{{"capture_version":"v1","retrieval_path":', coalesce(to_json(c.source_url)::varchar, 'null'), ',"traces":{{', coalesce(b, ''), '}}}}')), 32) context_id
from pol p join cur c using (article_id) left join tt using (article_id)""",
    "a5_condition_stats": f"""with {_joined(LEGACY, 'leg')}, f as (select token, cond, surface, count(*) n, min((article_id, pos)) seen from tok group by 1, 2, 3),
dd as (select token, cond, count(distinct article_id)::bigint doc_freq from tok group by 1, 2),
g as (select token, cond, sum(n)::bigint c, {_ENT} entropy, arg_min(surface, (-n, seen)) top_form from f group by 1, 2)
select {_rid('token', 'cond')} record_id, token token_norm, cond, c "count", doc_freq, entropy, top_form from g join dd using (token, cond)""",
    "a53_records_per_condition": f"with {_joined(LEGACY, 'leg')} select cond, count(distinct token)::bigint records, count(*)::bigint tokens from tok group by 1",
    "w3_specific_tokens": f"{_OF_TEXT} {_TOP}",
    "a54_specificity_summary": f"""{_OF_TEXT}, o as (select count(distinct token) n from sc where ca >= 2)
select cond, (any_value(o.n) + count(*) filter (ca < 2))::bigint total_tokens_compared, (count(*) filter (s > 0))::bigint positive_count, (count(*) filter (s < 0))::bigint negative_count from sc, o group by 1""",
    "w4_resonance": f"""{_OF_TEXT}, al as (select article_id, token from (select article_id, {norm('surface')} token from raw) where token is not null)
select article_id, cond, round(sum(s), 6) r from al join top using (token) group by 1, 2""",
    "w3_of_records": f"{_OF_RECORDS} {_TOP}",
    "f22_condition_ids": """select signature, h old_signature, h = signature same from (select signature,
  left(sha256('{' || (select string_agg(to_json(e.key)::varchar || ': ' || to_json(e.value)::varchar, ', ' order by e.key) from (select unnest(map_entries(factors)) e)) || '}'), 32) h from w2_conditions)""",
    "f14_record_ids": f"select row_id, {_rid('token_norm', 'condition_signature')} record_id, {_rid('token_norm', 'condition_signature')} = record_id same from w2_records",
}
