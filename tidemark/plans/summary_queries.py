"""Queries of summaries and top lists over votes, stored words and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import routing as R
from tidemark.functions import strings as T
from tidemark.operators import audit as A
from tidemark.plans.audit_queries import _V, _votes
from tidemark.plans.graph_queries import _EDGES, _edges
from tidemark.plans.lookup_queries import SQL as LOOKUP_SQL
from tidemark.plans.lookup_queries import f45_priorities
from tidemark.session import table


def a34_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by the band of their mean estimate and the statuses that compete on them."""
    g = _votes(spark, sf_dir).groupBy("aggregate_key").agg(F.round(F.avg("volatility_estimate"), 9).alias("v"), F.count_distinct("status").alias("s"))
    return g.filter("v is not null").groupBy(R.band(F.col("v"), F.col("s")).alias("band")).agg(F.count(F.lit(1)).alias("keys"), F.round(F.avg("s"), 7).alias("statuses"))


def a35_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often keys were observed, by the status of their last vote."""
    v = _votes(spark, sf_dir)
    g = v.groupBy("aggregate_key").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.coalesce("status", F.lit("none")), F.struct("voted_at", "vote_id")).alias("status"))
    return g.groupBy("status").agg(F.count(F.lit(1)).alias("keys"), F.round(F.avg("n"), 7).alias("observed"))


def a46_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of quality figures: votes, failed ones, reviews asked, flagged, out of range."""
    v = table(spark, sf_dir, "audit_votes_7cprime")
    none = F.col("status_suggestion").isNull() & F.col("volatility_estimate").isNull() & F.col("needs_human_review").isNull()
    return v.agg(
        F.count(F.lit(1)).alias("votes"),
        F.count(F.when(none, 1)).alias("failed"),
        F.count(F.when(F.col("needs_human_review"), 1)).alias("reviews"),
        F.count(F.when(F.size("risk_flags") > 0, 1)).alias("flagged"),
        F.count(F.when(~F.col("volatility_estimate").between(0, 1), 1)).alias("out_of_range"),
        F.count_distinct("aggregate_key").alias("keys"),
    )


def t13_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most urgent words."""
    return f45_priorities(spark, sf_dir).orderBy(F.desc("priority"), "token_norm").limit(100).select("token_norm", "priority")


def t19_top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest edge of each label."""
    e = _edges(spark, sf_dir).withColumn("s", F.round("raw_score", 9))
    return e.groupBy("label").agg(F.min_by("vec_id", F.struct(-F.col("s"), "vec_id")).alias("vec_id"), F.round(F.max("s"), 7).alias("raw_score"))


def a24_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unevenly each vector's positive edges are spread."""
    g = _edges(spark, sf_dir).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.round("raw_score", 9))).alias("w"))
    u = g.select("vec_id", R.uneven(F.col("w")).alias("u"))
    return u.select("vec_id", F.round("u.margin", 6).alias("margin"), F.round("u.entropy", 6).alias("entropy"))


def f30_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the last word of an item's answer stands in its text, and which place is nearest to the middle."""
    i = table(spark, sf_dir, "eval_items").withColumn("w", F.element_at(F.split("answer", " "), -1))
    i = i.withColumn("p", T.occurrences(F.col("text"), F.col("w")))
    near = T.nearest_occurrence(F.col("p"), F.floor(F.length("text") / 2).cast("int"))
    return i.select("item_id", F.size("p").cast("long").alias("n"), F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("places"), near.cast("long").alias("nearest"))


def u10_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each key that at least a third of its votes carry, and those dropped as too few."""
    v = _votes(spark, sf_dir)
    n = v.groupBy("aggregate_key").agg(F.count(F.lit(1)).alias("votes"))
    f = v.select("aggregate_key", F.explode(F.array_distinct("risk_flags")).alias("flag")).groupBy("aggregate_key", "flag").agg(F.count(F.lit(1)).alias("n"))
    return f.join(n, "aggregate_key").select("aggregate_key", "flag", (F.col("n") * 3 >= F.col("votes")).alias("kept"))


QUERIES = {f.__name__: f for f in (a34_bands, a35_observations, a46_quality, t13_pending, t19_top_edges, a24_uneven, f30_occurrences, u10_flags)}
SQL = {
    "a34_bands": f"""{_V}, g as (select aggregate_key, round(avg(e), 9) m, count(distinct status) s from v group by 1)
select case when m >= 0.5 then 'quarantine' when m >= 0.25 or s >= 2 then 'defer' else 'candidate' end band, count(*)::bigint keys, round(avg(s), 7) statuses from g where m is not null group by 1""",
    "a35_observations": f"""{_V}, g as (select aggregate_key, count(*) n, arg_max(coalesce(status, 'none'), (coalesce(voted_at, timestamptz '1900-01-01'), vote_id)) status from v group by 1)
select status, count(*)::bigint keys, round(avg(n), 7) observed from g group by 1""",
    "a46_quality": """select count(*)::bigint votes, (count(*) filter (status_suggestion is null and volatility_estimate is null and needs_human_review is null))::bigint failed, (count(*) filter (needs_human_review))::bigint reviews,
  (count(*) filter (len(risk_flags) > 0))::bigint flagged, (count(*) filter (not volatility_estimate between 0 and 1))::bigint out_of_range, count(distinct aggregate_key)::bigint keys from audit_votes_7cprime""",
    "t13_pending": f"select token_norm, priority from ({LOOKUP_SQL['f45_priorities']}) order by priority desc, token_norm limit 100",
    "t19_top_edges": f"with {_EDGES} select label, arg_min(vec_id, (-round(raw_score, 9), vec_id)) vec_id, round(max(round(raw_score, 9)), 7) raw_score from ed group by 1",
    "a24_uneven": f"""with {_EDGES}, w as (select vec_id, round(raw_score, 9) x, row_number() over (partition by vec_id order by round(raw_score, 9) desc) k, sum(round(raw_score, 9)) over (partition by vec_id) t from ed)
select vec_id, round(coalesce(max(x) filter (k = 1) - max(x) filter (k = 2), max(x)), 6) margin, round(-sum(x / t * ln(x / t)), 6) entropy from w group by 1""",
    "f30_occurrences": """with i as (select item_id, text, lower(string_split(answer, ' ')[-1]) w from eval_items),
p as (select item_id, text, case when coalesce(w, '') = '' or text is null then [] else list_filter(range(0, length(text)), lambda i: substr(lower(text), i + 1, length(w)) = w) end p from i)
select item_id, len(p)::bigint n, array_to_string(p, ',') places, (select arg_min(x, (abs(x - length(text) // 2), x)) from (select unnest(p) x)) nearest from p""",
    "u10_flags": f"""{_V}, n as (select aggregate_key, count(*) votes from v group by 1), f as (select aggregate_key, flag, count(*) n from (select aggregate_key, unnest(list_distinct(risk_flags)) flag from v) group by 1, 2)
select aggregate_key, flag, n * 3 >= votes kept from f join n using (aggregate_key)""",
}
