"""Queries of traces, the registry of contexts and comparisons of stored states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import traces as T
from tidemark.operators import registry as R
from tidemark.operators.compare import differences
from tidemark.operators.condense import current_vectors
from tidemark.operators.conditions import context_id, current_articles, traces_of
from tidemark.plans.text_sql import CURRENT, TRACES, lit
from tidemark.session import table


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = current_articles(table(spark, sf_dir, "articles")).withColumn("traces", traces_of(F.col("source_meta"), F.col("source_url")))
    return a.select("article_id", context_id(F.col("traces"), F.col("source_url")).alias("context_id"), "traces", F.col("source_url").alias("retrieval_path"))


def p10_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir).select("article_id", F.explode("traces").alias("key", "value"))


def p11_trace_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys found among traces, raw source data, condition factors and statuses, and why they can't be trace keys."""
    a = table(spark, sf_dir, "articles").select(F.explode(F.map_keys("source_meta")).alias("k"))
    raw = a.select(F.explode(F.array("k", F.concat(F.lit("legacy:"), "k"), F.concat(F.lit("type:"), "k"), F.concat(F.lit("html:"), "k", F.lit(":x")), F.concat(F.lit(":"), "k"), F.concat("k", F.lit(":")))).alias("key"))
    return raw.distinct().select("key", T.key_error(F.col("key")).alias("error"))


def p13_trace_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contexts(spark, sf_dir)
    return c.select("article_id", F.array_join(T.map_errors(F.col("traces")), "|").alias("errors"))


def p14_normal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of events as trace values: floats at nine places, whole numbers in the range of 32 bits."""
    e = table(spark, sf_dir, "events")
    big = F.get_json_object("props", "$.k").cast("long") * 50_000_000
    return e.select("event_id", T.normal_float(F.col("value") / 7).alias("value"), T.float_error(F.col("value")).alias("value_error"), T.normal_int(big).alias("whole"), T.int_error(big).alias("whole_error"))


def a50_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.namespace_summary(R.registered(_contexts(spark, sf_dir)))


def u9_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.registered(_contexts(spark, sf_dir)).select("context_id", "retrieval_path", "times", F.size(F.map_keys("traces")).cast("long").alias("n_traces"))


def p26_with_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.registered(_contexts(spark, sf_dir))
    some = R.with_trace(r, "legacy:source_type", "news").select("context_id", F.lit("news").alias("asked"))
    none = R.with_trace(r, "legacy:source_type", None).select("context_id", F.lit("none").alias("asked"))
    return some.unionByName(none)


def p27_with_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_namespace(R.registered(_contexts(spark, sf_dir)), "legacy").select("context_id")


def f22_stored_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of articles to contexts that don't follow from the article's own traces."""
    a = current_articles(table(spark, sf_dir, "articles")).filter("substrate_ref is not null")
    t = traces_of(F.col("source_meta"), F.col("source_url"))
    return R.verified(a.select("article_id", F.col("substrate_ref").alias("context_id"), t.alias("t"), "source_url"), context_id(F.col("t"), F.col("source_url"))).select("article_id", "context_id")


def j16_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record totals of the even batches against those of the odd ones."""
    r = table(spark, sf_dir, "w2_records").filter("record_id is not null")
    side = lambda p: r.filter(F.col("batch_no") % 2 == p).groupBy("record_id").agg(F.sum("count").alias("count"), F.sum("doc_freq").alias("doc_freq"))
    return differences(side(0), side(1), ["record_id"], ["count", "doc_freq"])


def j18_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each article's latest vector against its earliest: a projection run again should say the same."""
    w = table(spark, sf_dir, "w4_records").filter("article_id is not null")
    first = w.groupBy("article_id").agg(F.min_by("resonance_vector", F.struct("computed_at", F.coalesce("w4_run_id", F.lit("")))).alias("resonance_vector"))
    flat = lambda d: d.select("article_id", F.explode("resonance_vector").alias("dim", "v"))
    return differences(flat(first), flat(current_vectors(w)), ["article_id", "dim"], ["v"], 1e-8)


QUERIES = {
    f.__name__: f
    for f in (p10_traces, p11_trace_keys, p13_trace_errors, p14_normal_values, a50_namespaces, u9_registry, p26_with_trace, p27_with_namespace, f22_stored_contexts, j16_batches, j18_runs)
}
_names = lambda xs: ", ".join(map(lit, xs))


def _key_error(k: str) -> str:
    return f"""case when {k} is null then 'not_text' when not contains({k}, ':') then 'no_separator' when len(string_split({k}, ':')) <> 2 then 'many_separators'
  when split_part({k}, ':', 1) = '' then 'empty_namespace' when split_part({k}, ':', 2) = '' then 'empty_name' when split_part({k}, ':', 1) in ({_names(T.FORBIDDEN_NAMESPACES)}) then 'forbidden_namespace'
  when split_part({k}, ':', 2) in ({_names(T.FORBIDDEN_NAMES)}) and {k} not in ({_names(T.ALLOWED_KEYS)}) then 'forbidden_name' when not regexp_matches({k}, '^[a-z][a-z0-9_]*:[a-z][a-z0-9_]*$') then 'characters' end"""


_CTX = f"""with {CURRENT}, {TRACES},
tt as (select article_id, count(*) n, string_agg(to_json(tkey)::varchar || ':' || to_json(tval)::varchar, ',' order by tkey) b from ent2 group by 1),
cx as (select c.article_id, c.source_url, coalesce(n, 0) n, left(sha256(concat('{{"capture_version":"v1","retrieval_path":', coalesce(to_json(c.source_url)::varchar, 'null'), ',"traces":{{', coalesce(b, ''), '}}}}')), 32) context_id
  from cur c left join tt using (article_id))"""
SQL = {
    "p10_traces": f"{_CTX} select article_id, tkey \"key\", tval \"value\" from ent2",
    "p11_trace_keys": f"""with k as (select unnest(map_keys(source_meta)) k from articles), r as (select distinct unnest([k, 'legacy:' || k, 'type:' || k, 'html:' || k || ':x', ':' || k, k || ':']) "key" from k)
select "key", {_key_error('"key"')} error from r""",
    "p13_trace_errors": f"""{_CTX}, e as (select article_id, tkey || '=' || x e from (select article_id, tkey, coalesce({_key_error('tkey')}, case when length(tval) > 4096 then 'too_long' end) x from ent2) where x is not null)
select article_id, coalesce((select string_agg(e, '|' order by e) from e where e.article_id = c.article_id), '') errors from cur c""",
    "p14_normal_values": """select event_id, round("value" / 7, 9) "value", case when isnan("value") then 'nan' when isinf("value") then 'infinite' end value_error,
  greatest(-2147483648, least(2147483647, b)) whole, case when b < -2147483648 or b > 2147483647 then 'out_of_range' end whole_error from (select *, (props->>'$.k')::bigint * 50000000 b from events)""",
    "a50_namespaces": f"{_CTX} select split_part(tkey, ':', 1) namespace, count(distinct context_id)::bigint contexts from ent2 join cx using (article_id) group by 1",
    "u9_registry": f"{_CTX} select context_id, any_value(source_url) retrieval_path, count(*)::bigint times, any_value(n)::bigint n_traces from cx group by 1",
    "p26_with_trace": f"""{_CTX}, s as (select context_id, max(case when tkey = 'legacy:source_type' then tval end) v from cx left join ent2 using (article_id) group by 1)
select context_id, 'news' asked from s where v = 'news' union all select context_id, 'none' from s where v is null""",
    "p27_with_namespace": f"{_CTX} select distinct context_id from cx join ent2 using (article_id) where tkey like 'legacy:%'",
    "f22_stored_contexts": f"{_CTX} select c.article_id, c.substrate_ref context_id from cur c join cx using (article_id) where c.substrate_ref is not null and c.substrate_ref is distinct from cx.context_id",
    "j16_batches": """with s as (select record_id, batch_no % 2 p, sum("count") c, sum(doc_freq) d from w2_records where record_id is not null and batch_no is not null group by 1, 2),
j as (select coalesce(a.record_id, b.record_id) record_id, a.record_id ra, b.record_id rb, a.c ac, a.d ad, b.c bc, b.d bd from (select * from s where p = 0) a full join (select * from s where p = 1) b on a.record_id = b.record_id)
select record_id, case when ra is null then 'missing_left' when rb is null then 'missing_right' else 'changed' end difference,
  case when ra is not null and rb is not null then concat_ws(',', case when ac is distinct from bc then 'count' end, case when ad is distinct from bd then 'doc_freq' end) end fields
from j where ra is null or rb is null or ac is distinct from bc or ad is distinct from bd""",
    "j18_runs": """with w as (select *, row_number() over (partition by article_id order by computed_at nulls first, coalesce(w4_run_id, '')) lo, row_number() over (partition by article_id order by computed_at desc nulls last, coalesce(w4_run_id, '') desc) hi from w4_records where article_id is not null),
f as (select article_id, lo, hi, e.key dim, e.value v from (select article_id, lo, hi, unnest(map_entries(resonance_vector)) e from w)),
j as (select coalesce(a.article_id, b.article_id) article_id, coalesce(a.dim, b.dim) dim, a.dim ra, b.dim rb, a.v av, b.v bv from (select * from f where lo = 1) a full join (select * from f where hi = 1) b on a.article_id = b.article_id and a.dim = b.dim)
select article_id, dim, case when ra is null then 'missing_left' when rb is null then 'missing_right' else 'changed' end difference, case when ra is not null and rb is not null then 'v' end fields
from j where ra is null or rb is null or abs(coalesce(av, 0) - coalesce(bv, 0)) > 1e-8""",
}
