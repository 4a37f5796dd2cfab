"""Queries of the audit aggregates over the audit votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import audit as A
from tidemark.session import table


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest_votes(table(spark, sf_dir, "audit_votes_7cprime"))


def a37_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of the estimates per status (null: none given), out-of-range ones included."""
    g = A.spread(_votes(spark, sf_dir), "volatility_estimate", "status")
    return g.select("status", "n", "missing", *[F.round(c, 7).alias(c) for c in g.columns[3:]])


def a41_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tally(_votes(spark, sf_dir), F.coalesce("status", F.lit("none")), "status")


def a43_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _votes(spark, sf_dir).select(F.explode(F.array_distinct("risk_flags")).alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    pairs = A.flag_pairs(_votes(spark, sf_dir), "risk_flags")
    return one.select("a", F.lit("").alias("b"), "n").unionByName(pairs)


def a45_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vote_drift(_votes(spark, sf_dir)).withColumn("spread", F.round("spread", 9))


def a48_drift_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.drift_scores(_votes(spark, sf_dir), "aggregate_key", "status").withColumn("drift", F.round("drift", 4))


def a49_drift_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean drift of keys per engine version of the auditors, unknown ones under their own name."""
    v = _votes(spark, sf_dir).join(F.broadcast(table(spark, sf_dir, "auditors").select("auditor_id", "engine_version")), "auditor_id", "left")
    v = v.withColumn("engine_version", F.coalesce("engine_version", F.lit("unknown"))).withColumn("item", F.struct("engine_version", "aggregate_key"))
    d = A.drift_scores(v, "item", "status")
    return d.groupBy(F.col("item.engine_version").alias("engine_version")).agg(F.count(F.lit(1)).alias("keys"), F.round(F.avg("drift"), 7).alias("drift"))


def a47_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per profile: votes, those with a status, with a review asked, and how many different answers."""
    v = _votes(spark, sf_dir)
    answer = F.sha2(F.concat_ws("|", F.coalesce("status", F.lit("")), F.array_join(F.sort_array(F.coalesce("risk_flags", F.array().cast("array<string>"))), ",")), 256)
    g = v.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("votes"),
        F.round(F.avg(F.col("status").isNotNull().cast("double")), 8).alias("status_rate"),
        F.round(F.avg(F.coalesce(F.col("needs_human_review"), F.lit(False)).cast("double")), 8).alias("review_rate"),
        F.count_distinct(answer).alias("answers"),
    )
    return g


def a44_like_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes alike in status, band of the estimate and routes stressed, in groups of two or more."""
    v = _votes(spark, sf_dir).filter("status is not null and volatility_estimate is not null")
    band = F.when(F.col("volatility_estimate") >= A.HIGH, "high").when(F.col("volatility_estimate") >= A.LOW, "mid").otherwise("low")
    routes = F.array_join(F.sort_array(F.coalesce("route_emphasis", F.array().cast("array<string>"))), "")
    g = A.like_groups(v.withColumns({"band": band, "routes": routes}), ["status", "band", "routes"], "volatility_estimate")
    return g.withColumns({c: F.round(c, 7) for c in ("mean", "cohesion")})


def wn7_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _votes(spark, sf_dir)
    h = A.recent_history(v, "aggregate_key", ["voted_at", "vote_id"], "volatility_estimate")
    return h.select("aggregate_key", F.array_join(F.transform("history", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("history"), "rising", "settled")


def a32_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key: votes, mean and largest estimate, votes per status, up to five first rationales, all routes."""
    v = table(spark, sf_dir, "audit_votes_7cprime").filter("aggregate_key is not null")
    st = A.status_word(F.col("status_suggestion"))
    g = v.groupBy("aggregate_key").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg("volatility_estimate"), 7).alias("mean"),
        F.max("volatility_estimate").alias("most"),
        *[F.count(F.when(st == s, 1)).alias(s) for s in ("candidate", "defer", "quarantine")],
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("route_emphasis")))), "").alias("routes"),
    )
    return g


def j11_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose votes spread widely but of which no vote asks for a review, and those that ask for one."""
    d = A.vote_drift(_votes(spark, sf_dir))
    asked = d.filter("reviews > 0").select("aggregate_key", F.lit("asked").alias("kind"))
    missed = d.filter("spread >= 0.3").join(asked.select("aggregate_key"), "aggregate_key", "left_anti").select("aggregate_key", F.lit("missed").alias("kind"))
    return asked.unionByName(missed)


QUERIES = {
    f.__name__: f
    for f in (a37_volatility, a41_statuses, a43_flags, a45_drift, a48_drift_scores, a49_drift_by_version, a47_rates, a44_like_groups, wn7_history, a32_aggregates, j11_reviews)
}
_V = """with v as (select *, nullif(regexp_replace(lower(status_suggestion), '[^a-z]', '', 'g'), '') status, volatility_estimate e from
  (select *, row_number() over (partition by aggregate_key, auditor_id order by voted_at desc nulls last, vote_id desc) k from audit_votes_7cprime where aggregate_key is not null and auditor_id is not null) where k = 1)"""
_DRIFT = f"""{_V}, n as (select aggregate_key, count(*)::bigint votes, max(e) - min(e) spread, (count(*) filter (needs_human_review))::bigint reviews from v group by 1),
s as (select aggregate_key, status, count(*) n from v where status is not null group by 1, 2), s2 as (select aggregate_key, count(*)::bigint statuses, arg_min(status, (-n, status)) lead_status from s group by 1),
f as (select aggregate_key, flag, count(*) n from (select aggregate_key, unnest(list_distinct(risk_flags)) flag from v) group by 1, 2),
f2 as (select aggregate_key, string_agg(flag, '|' order by flag) a, string_agg(flag, '|' order by flag) filter (f.n = votes) b, string_agg(flag, '|' order by flag) filter (f.n <> votes) c from f join n using (aggregate_key) group by 1),
d as (select aggregate_key, votes, coalesce(statuses, 0)::bigint statuses, lead_status, reviews, coalesce(a, '') flags_any, coalesce(b, '') flags_all, coalesce(c, '') flags_conflict, spread from n left join s2 using (aggregate_key) left join f2 using (aggregate_key))"""
_SPREAD = """count(e)::bigint n, (count(*) filter (e is null))::bigint missing, round(avg(e), 7) mean, round(stddev_samp(e), 7) deviation, round(min(e), 7) least, round(max(e), 7) most,
  round(quantile_cont(e, 0.7), 7) p70, round(quantile_cont(e, 0.8), 7) p80, round(quantile_cont(e, 0.9), 7) p90, round(avg((e >= 0.5)::int), 7) high_rate, round(avg((e < 0.25)::int), 7) low_rate"""
SQL = {
    "a37_volatility": f"{_V} select status, {_SPREAD} from v group by 1",
    "a41_statuses": f"{_V} select coalesce(status, 'none') status, count(*)::bigint n from v group by 1",
    "a43_flags": f"""{_V}, x as (select row_number() over () r, list_distinct(risk_flags) fl from v), y as (select r, unnest(fl) f from x)
select f a, '' b, count(*)::bigint n from y group by 1 union all select * from (select p.f, q.f, count(*)::bigint n from y p join y q on p.r = q.r and p.f < q.f group by 1, 2 order by n desc, 1, 2 limit 10)""",
    "a45_drift": f"{_DRIFT} select * replace (round(spread, 9) as spread) from d",
    "a48_drift_scores": f"""{_V}, g as (select aggregate_key, count(*)::bigint runs, (count(distinct status) + max((status is null)::int))::bigint outcomes from v group by 1)
select aggregate_key, runs, outcomes, round(case when runs > 1 then (outcomes - 1) / (runs - 1) else 0.0 end, 4) drift from g""",
    "a49_drift_by_version": f"""{_V}, g as (select coalesce(engine_version, 'unknown') engine_version, aggregate_key, count(*) runs, count(distinct status) + max((status is null)::int) outcomes from v left join auditors using (auditor_id) group by 1, 2)
select engine_version, count(*)::bigint keys, round(avg(case when runs > 1 then (outcomes - 1) / (runs - 1) else 0.0 end), 7) drift from g group by 1""",
    "a47_rates": f"""{_V} select profile_id, count(*)::bigint votes, round(avg((status is not null)::int), 8) status_rate, round(avg(coalesce(needs_human_review, false)::int), 8) review_rate,
  count(distinct coalesce(status, '') || '|' || array_to_string(list_sort(coalesce(risk_flags, [])), ','))::bigint answers from v group by 1""",
    "a44_like_groups": f"""{_V} select status, band, routes, count(*)::bigint members, round(avg(e), 7) mean, round(greatest(0.0, 1 - coalesce(stddev_samp(e), 0)), 7) cohesion from
  (select *, case when e >= 0.5 then 'high' when e >= 0.25 then 'mid' else 'low' end band, array_to_string(list_sort(coalesce(route_emphasis, [])), '') routes from v where status is not null and e is not null)
group by 1, 2, 3 having count(*) >= 2 order by members desc, status, band, routes limit 20""",
    "wn7_history": f"""{_V}, r as (select aggregate_key, e, row_number() over (partition by aggregate_key order by voted_at desc nulls last, vote_id desc) r from v where e is not null),
h as (select aggregate_key, string_agg(round(e * 1000)::bigint::varchar, ',' order by r desc) history, max(e) filter (r = 1) e1, max(e) filter (r = 2) e2, max(e) filter (r <= 3) hi, min(e) filter (r <= 3) lo, count(*) n from r where r <= 10 group by 1)
select aggregate_key, history, case when n >= 2 then e1 > e2 end rising, case when n >= 3 then hi - lo < 0.1 end settled from h""",
    "a32_aggregates": """with v as (select *, nullif(regexp_replace(lower(status_suggestion), '[^a-z]', '', 'g'), '') st from audit_votes_7cprime where aggregate_key is not null),
r as (select aggregate_key, string_agg(x, '' order by x) routes from (select distinct aggregate_key, unnest(route_emphasis) x from v) group by 1)
select aggregate_key, count(*)::bigint "rows", round(avg(volatility_estimate), 7) mean, max(volatility_estimate) most, (count(*) filter (st = 'candidate'))::bigint candidate, (count(*) filter (st = 'defer'))::bigint "defer",
  (count(*) filter (st = 'quarantine'))::bigint quarantine, coalesce(any_value(routes), '') routes from v left join r using (aggregate_key) group by 1""",
    "j11_reviews": f"{_DRIFT} select aggregate_key, 'asked' kind from d where reviews > 0 union all select aggregate_key, 'missed' from d where spread >= 0.3 and reviews = 0",
}
