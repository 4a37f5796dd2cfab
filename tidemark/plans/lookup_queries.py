"""Queries of lookups, caches and keyed states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scores import data_weight, priority
from tidemark.operators import keyed_state as S
from tidemark.operators import lookup as L
from tidemark.plans.event_queries import LEVELS, molecules
from tidemark.plans.graph_queries import _EDGES, _edges
from tidemark.session import spread, table

NOW = "2026-01-01 00:00:00"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "eval_items").select(F.col("suite").alias("concept"), F.split("answer", " ").alias("triggers"))
    return L.trigger_index(g, "concept", "triggers")


def a59_trigger_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


def j10_triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three suites whose answers' words stand most often in each document."""
    m = L.triggered(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", _index(spark, sf_dir), "concept", 3)
    return m.select("doc_id", F.col("rank").cast("long").alias("rank"), "concept", "score", "words")


def j9_stand_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every vector; two of three have none of their own and take those of a neighbour."""
    e = _edges(spark, sf_dir).filter("vec_id % 3 = 0").withColumn("raw_score", F.round("raw_score", 7))
    v = table(spark, sf_dir, "embeddings").select("vec_id")
    near = F.array(*[F.struct((F.col("vec_id") + d).alias("neighbour"), F.lit(r).alias("relation"), F.lit(p).alias("position")) for d, r, p in ((1, "similar", 0), (-1, "similar", 1), (7, "hypernym", 0), (4, "part_holonym", 10))])
    rel = v.select("vec_id", F.explode(near).alias("n")).select("vec_id", "n.*")
    return L.with_stand_ins(v, e, rel, "vec_id").select("vec_id", "source", "decay", "label", "raw_score")


def f45_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "w2_records").filter("token_norm is not null")
    g = r.groupBy("token_norm").agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("t"), F.max(F.coalesce("doc_freq", F.lit(0))).alias("d"))
    days = F.floor((F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros("t")) / (86400 * 10**6))
    return g.select("token_norm", priority(F.col("n"), days, F.col("d") > 1).alias("priority"), F.round(data_weight(F.col("n")), 4).alias("data_weight"))


def st21_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose last record isn't older than a week at the time of the newest record."""
    c = table(spark, sf_dir, "w2_records").filter("token_norm is not null and updated_at is not null").groupBy("token_norm").agg(F.max("updated_at").alias("stored_at"))
    now = c.agg(F.max("stored_at").alias("now"))
    return L.live(c.join(now), F.col("now")).select("token_norm", F.unix_micros("stored_at").alias("stored_at"))


def st12_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "audit_votes_7cprime").filter("aggregate_key is not null and vote_id is not null").dropDuplicates(["vote_id"])
    o = v.select("aggregate_key", "voted_at", "vote_id", F.col("volatility_estimate").alias("volatility"), (F.unix_micros("voted_at") / 1e6).alias("seconds"))
    return S.aggregate_states(o, "aggregate_key", ["voted_at", "vote_id"])


def p36_molecule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules of events against a glossary that lacks one atom and some levels."""
    m = molecules(spark, sf_dir).select("event_id", "formula", F.array(F.struct(F.col("atoms")[0].alias("atom"), F.lit("temporal").alias("axis"), F.col("level").alias("level"))).alias("active"))
    levels = spark.createDataFrame([(a, "temporal", x) for a in ("view", "click", "signup", "purchase") for x in LEVELS[:4]], "atom string, axis string, level string")
    return L.molecule_errors(m, levels, "event_id")


QUERIES = {f.__name__: f for f in (a59_trigger_index, j10_triggered, j9_stand_ins, f45_priorities, st21_live, st12_states, p36_molecule_errors)}
_TRIG = "tr as (select distinct trim(lower(t)) word, concept from (select suite concept, unnest(string_split(answer, ' ')) t from eval_items where answer is not null) where trim(lower(t)) <> '')"
_lv = ", ".join(f"'{x}'" for x in LEVELS)
_four = ", ".join(f"'{x}'" for x in LEVELS[:4])
SQL = {
    "a59_trigger_index": f"with {_TRIG} select * from tr",
    "j10_triggered": f"""with {_TRIG}, w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) word from documents),
m as (select doc_id, concept, count(*) * 0.5 score, count(distinct word)::bigint words from w join tr using (word) group by 1, 2)
select doc_id, k "rank", concept, score::double score, words from (select *, row_number() over (partition by doc_id order by score desc, concept) k from m) where k <= 3""",
    "j9_stand_ins": f"""with {_EDGES}, e as (select vec_id, label, round(raw_score, 7) raw_score from ed where vec_id % 3 = 0), tp as (select vec_id, max(raw_score) t from e group by 1),
n as (select vec_id, vec_id + d neighbour, dc from embeddings, (values (1, 0.8), (-1, 0.8), (7, 0.5)) r(d, dc) where vec_id not in (select vec_id from e)),
b as (select n.vec_id, arg_min((neighbour, dc), (-t, -dc, neighbour)) x from n join tp on tp.vec_id = neighbour group by 1)
select vec_id, vec_id source, 1.0::double decay, label, raw_score from e union all select b.vec_id, e.vec_id, x[2]::double, label, raw_score from b join e on e.vec_id = x[1]""",
    "f45_priorities": f"""with g as (select token_norm, count(*) n, max(updated_at) t, max(coalesce(doc_freq, 0)) d from w2_records where token_norm is not null group by 1)
select token_norm, round((least(1.0, sqrt(n / 100.0)) * greatest(0.1, 1 - floor((epoch_us(timestamp '{NOW}') - epoch_us(t)) / 86400000000) / 30.0) * case when d > 1 then 1.0 else 0.5 end)::double, 4) priority, round(least(0.7, n * 0.007)::double, 4) data_weight from g""",
    "st21_live": """with c as (select token_norm, max(epoch_us(updated_at)) stored_at from w2_records where token_norm is not null and updated_at is not null group by 1)
select * from c where stored_at + 604800000000 > (select max(stored_at) from c)""",
    "p36_molecule_errors": f"""with m0 as (select event_id, event_type atom, (props->>'$.k')::bigint k from events), m as (select *, ([{_lv}])[(k % 7 + 1)::int] lvl,
  case when k % 10 <> 0 then 'aa_' || (k % 7) end fid from m0)
select event_id, 'unknown_atom' error, atom what from m where atom = 'error' union all select event_id, 'unknown_level', atom || '/temporal/' || lvl from m where atom <> 'error' and lvl not in ({_four})
union all select event_id, 'undefined_id', fid from m where fid is not null""",
}
