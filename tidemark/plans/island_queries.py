"""Queries of condensation and report over the scopes of stored observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import condense as C
from tidemark.operators import stats as S
from tidemark.operators.conditions import current_articles
from tidemark.plans.stats_queries import SQL as STATS_SQL
from tidemark.plans.stats_queries import stored_counts
from tidemark.session import table


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observation's members, in islands or noise, with its threshold (0.7 where null) and least size (3)."""
    o = table(spark, sf_dir, "w6_observatory")
    empty = F.expr("cast(array() as array<string>)")
    ids = F.concat(F.flatten(F.transform(F.coalesce("islands", F.array().cast(o.schema["islands"].dataType)), lambda i: F.coalesce(i["member_ids"], empty))), F.coalesce("noise_ids", empty))
    m = o.select(F.col("observation_id").alias("scope"), F.coalesce("threshold", F.lit(0.7)).alias("threshold"), F.coalesce("min_island_size", F.lit(3)).alias("min_size"), F.explode(ids).alias("article_id"))
    return m.filter("article_id is not null").distinct()


def _done(spark: SparkSession, sf_dir: str) -> C.Condensed:
    return C.Condensed(members(spark, sf_dir), table(spark, sf_dir, "w4_records"))


def j4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = C.current_vectors(table(spark, sf_dir, "w4_records"))
    return C.links(members(spark, sf_dir), v).select("scope", "a", "b", F.round("sim", 9).alias("sim"))


def w5_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(spark, sf_dir).islands()


def w5_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(spark, sf_dir).membership


def a15_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(spark, sf_dir).centroids().withColumn("v", F.round("v", 7))


def w5_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(spark, sf_dir).structures()


def t5_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(spark, sf_dir).vector_digest().select("scope", "first", F.col("rank").cast("long").alias("rank"), "dim", F.round("v", 7).alias("v"))


def a18_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _done(spark, sf_dir).evidence(S.specific_tokens(S.scored(stored_counts(spark, sf_dir))))
    return e.select("scope", "first", F.col("rank").cast("long").alias("rank"), "token", F.round("score", 8).alias("score"), "presence")


def a21_used_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(spark, sf_dir).used_analyses()


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles").select("article_id").filter("article_id is not null").distinct()
    return a.join(table(spark, sf_dir, "documents").select("article_id", "text"), "article_id")


def t7_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _done(spark, sf_dir).representatives(_articles(spark, sf_dir))
    return r.select("scope", "first", F.col("rank").cast("long").alias("rank"), "article_id", "w4_analysis_id", F.round("magnitude", 7).alias("magnitude"), F.md5("snippet").alias("snippet"))


def t8_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _done(spark, sf_dir).topology()
    return t.select("scope", F.col("rank").cast("long").alias("rank"), "pair_id", "island_a", "island_b", F.round("distance", 8).alias("distance"))


def w6_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(spark, sf_dir).observations()


def p44_outside_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.outside_scope(members(spark, sf_dir), table(spark, sf_dir, "w4_records"), table(spark, sf_dir, "articles"))


def p45_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repeated_ids(table(spark, sf_dir, "w4_records"))


def a19_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every article's vector and the ids that name its projection."""
    v = C.current_vectors(table(spark, sf_dir, "w4_records"))
    return v.select("article_id", F.round(C.magnitude(F.col("resonance_vector")), 7).alias("magnitude"), F.size(F.map_keys("resonance_vector")).cast("long").alias("dims"))


QUERIES = {
    f.__name__: f
    for f in (
        j4_links,
        w5_islands,
        w5_membership,
        a15_centroids,
        w5_structures,
        t5_digests,
        a18_evidence,
        a21_used_analyses,
        t7_representatives,
        t8_topology,
        w6_observations,
        p44_outside_scope,
        p45_repeated,
        a19_magnitudes,
    )
}
_MEM = """mem as (select distinct scope, threshold, min_size, article_id from (select observation_id scope, coalesce(threshold, 0.7) threshold, coalesce(min_island_size, 3) min_size,
  unnest(flatten([coalesce(i.member_ids, []) for i in coalesce(islands, [])]) || coalesce(noise_ids, [])) article_id from w6_observatory) where article_id is not null),
vec as (select * from (select *, row_number() over (partition by article_id order by computed_at desc nulls last, coalesce(w4_run_id, '') desc) k from w4_records where article_id is not null) where k = 1),
al as (select article_id, e.key dim, e.value v from (select article_id, unnest(map_entries(resonance_vector)) e from vec)),
ent as (select article_id, dim, v from al where v is not null and not isnan(v) and v <> 0),
nrm as (select article_id, sqrt(sum(v * v)) n from ent group by 1 having sqrt(sum(v * v)) >= 1e-12),
un as (select article_id, dim, v / n v from ent join nrm using (article_id)),
lk as (select x.scope, x.article_id a, y.article_id b, any_value(x.threshold) th, round(sum(p.v * q.v), 12) sim
  from mem x join mem y on x.scope = y.scope and x.article_id < y.article_id join un p on p.article_id = x.article_id join un q on q.article_id = y.article_id and q.dim = p.dim
  group by 1, 2, 3 having round(sum(p.v * q.v), 12) >= any_value(x.threshold))"""
_BASE = f"""with recursive {_MEM},
sy as (select scope, a u, b v from lk union all select scope, b, a from lk),
rc as (select scope, article_id x, article_id y from mem join vec using (article_id) union select rc.scope, rc.x, sy.v from rc join sy on sy.scope = rc.scope and sy.u = rc.y),
lb as (select scope, x article_id, min(y) "first", count(*) size from rc group by 1, 2),
ms as (select scope, article_id, "first", size, size >= min_size in_island from lb join mem using (scope, article_id)),
ins as (select * from ms where in_island),
isl as (select scope, "first", count(*) size, sha256('{{"members":[' || string_agg('"' || article_id || '"', ',' order by article_id) || ']}}') island_id from ins group by 1, 2),
cen as (select scope, "first", dim, round(coalesce(sum(v), 0) / any_value(size), 9) v from ins join al using (article_id) group by 1, 2, 3),
str as (select scope, sha256('{{"algorithm":"ResonanceCondensation-v1","input_w4_ids":[' || string_agg('"' || w4_analysis_id || '"', ',' order by w4_analysis_id) || '],"min_island_size":' || any_value(min_size)
  || ',"threshold":' || any_value(threshold) || ',"vector_policy":"mean_raw_v1"}}') structure_id, count(*)::bigint input_count from mem join vec using (article_id) group by 1),
stn as (select scope, structure_id, input_count, (select count(*) from ms where ms.scope = str.scope and not in_island)::bigint noise_count, (select count(*) from isl where isl.scope = str.scope)::bigint island_count from str)"""
_TOP = STATS_SQL["w3_of_records"].split("select cond, case when")[0].strip().removeprefix("with")
SQL = {
    "j4_links": f"with {_MEM} select scope, a, b, round(sim, 9) sim from lk",
    "w5_islands": f"""{_BASE}, co as (select lk.scope, "first", round(avg(sim), 6) cohesion from lk join ins on ins.scope = lk.scope and ins.article_id = lk.a group by 1, 2)
select scope, island_id, "first", size::bigint size, coalesce(cohesion, 1.0) cohesion from isl left join co using (scope, "first")""",
    "w5_membership": f'{_BASE} select scope, article_id, "first", size::bigint size, in_island from ms',
    "a15_centroids": f'{_BASE} select scope, "first", dim, round(v, 7) v from cen',
    "w5_structures": f"{_BASE} select * from stn",
    "t5_digests": f"""{_BASE} select scope, "first", k "rank", dim, round(v, 7) v from (select *, row_number() over (partition by scope, "first" order by abs(v) desc, dim) k from cen) where k <= 10""",
    "a18_evidence": f"""{_BASE}, {_TOP}, nn as (select scope, "first", dim cond, count(*) n from ins join al using (article_id) group by 1, 2, 3),
ev as (select scope, "first", token, round(sum(n * s) / sum(n), 12) score, sum(n)::bigint presence from nn join top using (cond) group by 1, 2, 3)
select scope, "first", k "rank", token, round(score, 8) score, presence from (select *, row_number() over (partition by scope, "first" order by abs(score) desc, token) k from ev) where k <= 20""",
    "a21_used_analyses": f"""{_BASE} select scope, "first", left(sha256('[' || string_agg('"' || w || '"', ',' order by w) || ']'), 32) used_w3_digest
from (select distinct scope, "first", unnest(map_values(used_w3)) w from ins join vec using (article_id)) group by 1, 2""",
    "t7_representatives": f"""{_BASE}, mg as (select article_id, round(sqrt(sum(v * v)), 9) m from al group by 1),
rk as (select scope, "first", article_id, coalesce(m, 0) m, row_number() over (partition by scope, "first" order by coalesce(m, 0) desc, article_id) k from ins left join mg using (article_id)
  where article_id in (select a.article_id from articles a join documents d using (article_id)))
select scope, "first", rk.k "rank", article_id, w4_analysis_id, round(m, 7) magnitude, md5(left(coalesce(text, ''), 200)) snippet from rk join vec using (article_id) join documents using (article_id) where rk.k <= 3""",
    "t8_topology": f"""{_BASE}, ci as (select scope, island_id, dim, v from cen join isl using (scope, "first")), cn as (select scope, island_id, sqrt(sum(v * v)) n from ci group by 1, 2),
pr as (select x.scope, x.island_id a, y.island_id b, x.n na, y.n nb, (select coalesce(sum(p.v * q.v), 0) from ci p join ci q on p.dim = q.dim where p.scope = x.scope and q.scope = x.scope and p.island_id = x.island_id and q.island_id = y.island_id) dot
  from cn x join cn y on x.scope = y.scope and x.island_id < y.island_id),
di as (select scope, left(sha256(concat('{{"island_a":"', a, '","island_b":"', b, '","metric":"cosine_dist_v1"}}')), 32) pair_id, a island_a, b island_b,
  case when na < 1e-12 or nb < 1e-12 then 2.0 else round(1 - round(dot / (na * nb), 12), 12) end distance from pr)
select scope, k "rank", pair_id, island_a, island_b, round(distance, 8) distance from (select *, row_number() over (partition by scope order by round(distance, 9), pair_id) k from di) where k <= 10""",
    "w6_observations": f"""{_BASE}, il as (select scope, string_agg('"' || island_id || '"', ',' order by island_id) ids from isl group by 1)
select scope, sha256(concat('{{"code_version":"v5.4.8-MIG.3","island_ids":[', coalesce(ids, ''), '],"normalizer_version":"v9.1.0","scope_id":"', scope, '","structure_id":"', structure_id, '","tokenizer_version":"hybrid_v1"}}')) observation_id,
  structure_id, island_count, noise_count from stn left join il using (scope)""",
    "p44_outside_scope": f"""with {_MEM} select distinct scope, article_id, 'projection' missing from mem where article_id not in (select article_id from w4_records where article_id is not null)
union all select distinct scope, article_id, 'article' from mem where article_id not in (select article_id from articles where article_id is not null)""",
    "p45_repeated": "select article_id, count(*)::bigint n from w4_records group by 1 having count(*) > 1",
    "a19_magnitudes": f"""with {_MEM}, mg as (select article_id, sqrt(sum(v * v)) m from al group by 1)
select article_id, case when resonance_vector is not null then round(coalesce(m, 0), 7) end magnitude, cardinality(resonance_vector)::bigint dims from vec left join mg using (article_id)""",
}
