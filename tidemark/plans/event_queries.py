"""Queries of ledger, memory and index over the events table, each event read as one observed molecule.

Atoms are the event's type and one of seven marks from its number k; operator, direction and temporal level follow from
k as well. Each user has a ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import canonical as C
from tidemark.functions.molecules import formula_signature, operator_type
from tidemark.functions.scores import tau_of, tau_text
from tidemark.operators import ledger as L
from tidemark.operators import memory as M
from tidemark.operators import semindex as X
from tidemark.session import table

LEVELS = ["permanence", "continuation", "establishment", "transformation", "indication", "emergence", "other"]


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    e = e.withColumn("k", k).withColumn("mark", F.concat(F.lit("aa_"), (F.col("k") % 7).cast("string")))
    op = F.element_at(F.array(*map(F.lit, ["▷", "→", "⊕"])), (F.col("k") % 3 + 1).cast("int"))
    e = e.withColumn("op", op)
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("at"),
        "user_id",
        "k",
        F.array("event_type", "mark").alias("atoms"),
        F.array("op").alias("operators"),
        F.when(F.col("k") % 10 != 0, F.concat_ws(" ", "event_type", "op", "mark")).alias("formula"),
        F.when(F.col("k") % 5 == 0, "-|>").when(F.col("k") % 5 < 3, "=>+").otherwise("=>").alias("direction"),
        F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("k") % 7 + 1).cast("int")).alias("level"),
        F.col("event_id").alias("seq"),
        "value",
    ).withColumn("formula_signature", formula_signature(F.col("formula"), F.col("atoms"), F.col("operators")))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    data = C.json_object({"atoms": C.json_array(F.col("atoms")), "formula": C.quoted(F.col("formula"))})
    return m.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("ledger_id"),
        "at",
        F.col("event_id").alias("row_id"),
        F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
        F.lit("molecule.observe").alias("event_type"),
        "direction",
        data.alias("data"),
        F.lit('{"actor":"Engine","engine_version":"1"}').alias("meta"),
    )


def f17_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids: events that say the same have the same id, whenever they happened."""
    e = _events(spark, sf_dir)
    return e.select("row_id", C.event_id(F.lit(1), F.col("ledger_id"), F.col("event_type"), F.col("direction"), F.col("data")).alias("event_id"))


def st4_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.chained(L.with_genesis(_events(spark, sf_dir))).select("ledger_id", "seq", "event_id", "prev", "self")


def st7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults found in ledgers whose entries with certain numbers were changed, lost or torn after writing."""
    d = L.chained(L.with_genesis(_events(spark, sf_dir))).withColumn("line", F.col("seq"))
    d = d.filter((F.col("seq") % 17 != 5) | (F.col("seq") % 2 == 0))
    d = d.withColumn("data", F.when(F.col("seq") % 23 == 7, F.lit("{}")).otherwise(F.col("data")))
    d = d.withColumn("algo", F.when(F.col("seq") % 31 == 9, F.lit("md5")).otherwise(F.col("algo")))
    d = d.withColumn("seq", F.when(F.col("seq") % 41 == 11, F.lit(None)).otherwise(F.col("seq")))
    return L.faults(d)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    print_ = C.fingerprint(F.col("atoms"), operator_type(F.col("formula")))
    return m.select(print_.alias("fingerprint"), "at", "event_id", tau_of(F.array("level")).alias("tau"))


def st1_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.replay(_observed(spark, sf_dir))
    return m.select("fingerprint", F.col("tau").cast("long").alias("tau"), tau_text(F.col("tau").cast("long")).alias("tau_text"), F.round("weight", 8).alias("weight"), "observation_count", F.unix_micros("created_at").alias("created_at"), F.unix_micros("last_updated").alias("last_updated"))


def _later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.aged(M.replay(_observed(spark, sf_dir)), F.lit("2024-02-01 00:00:00").cast("timestamp"))


def st2_aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _later(spark, sf_dir).select("fingerprint", F.round("weight", 8).alias("weight"), "purge", F.unix_micros("last_updated").alias("last_updated"))


def p24_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.active(_later(spark, sf_dir).filter("not purge")).select("fingerprint", F.round("weight", 8).alias("weight"))


def a26_memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.memory_stats(M.replay(_observed(spark, sf_dir)))
    return s.select("entries", "observations", *[F.round(c, 7).alias(c) for c in ("avg_weight", "max_weight", "min_weight")])


def a27_rigidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.atom_stats(molecules(spark, sf_dir)).withColumn("rigidity", F.round("rigidity", 8))


def a29_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cooccurrence(molecules(spark, sf_dir))


def a30_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.direction_balance(molecules(spark, sf_dir), 10**9)
    return g.withColumns({c: F.round(c, 8) for c in ("r_creative", "r_destructive")})


def t10_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.IndexView(molecules(spark, sf_dir)).related("view")


def t18_rigid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.IndexView(molecules(spark, sf_dir))
    pick = lambda d, w: d.select(F.lit(w).alias("side"), "atom", F.round("rigidity", 8).alias("rigidity"))
    return pick(v.rigid(), "rigid").unionByName(pick(v.volatile(), "volatile"))


QUERIES = {
    f.__name__: f
    for f in (f17_event_ids, st4_ledger, st7_faults, st1_memory, st2_aged, p24_active, a26_memory_stats, a27_rigidity, a29_cooccurrence, a30_directions, t10_related, t18_rigid)
}
_lv = "[" + ", ".join(f"'{x}'" for x in LEVELS) + "]"
_M = f"""m0 as (select event_id, ts "at", user_id, event_type, (props->>'$.k')::bigint k, value from events),
m1 as (select *, 'aa_' || (k % 7) mark, (['▷', '→', '⊕'])[(k % 3 + 1)::int] op, case when k % 5 = 0 then '-|>' when k % 5 < 3 then '=>+' else '=>' end direction, ({_lv})[(k % 7 + 1)::int] lvl from m0),
m2 as (select *, case when k % 10 <> 0 then event_type || ' ' || op || ' ' || mark end formula from m1),
mol as (select *, coalesce(formula, array_to_string(list_sort([event_type, mark]), '|') || '::' || op) fsig, case when formula is null then 'ATOM_ONLY' else op end otype from m2)"""
_EV = f"""{_M}, ev as (select 'user-' || user_id ledger_id, "at", event_id row_id, strftime("at", '%Y-%m-%dT%H:%M:%S.%fZ') ts, 'molecule.observe' event_type, direction,
  concat('{{"atoms":["', event_type, '","', mark, '"],"formula":', coalesce(to_json(formula)::varchar, 'null'), '}}') "data", '{{"actor":"Engine","engine_version":"1"}}' meta from mol)"""
_EID = """sha256(concat('{"data":', "data", ',"direction":"', direction, '","event_type":"', event_type, '","ledger_id":"', ledger_id, '","v":1}'))"""
_BODY = """concat('{"data":', "data", ',"direction":"', direction, '","event_type":"', event_type, '","hash":{"algo":"', algo, '","event_id":"', event_id, '","prev":"', prev, '"},"ledger_id":"', ledger_id, '","meta":', meta, ',"seq":', seq, ',"ts":"', ts, '","v":1}')"""
_SELF = f"sha256(concat(prev, chr(10), {_BODY}))"
_CHAIN = f"""with recursive {_EV},
gs as (select *, row_number() over (partition by ledger_id order by "at", row_id) seq from ev
  union all select ledger_id, min("at"), min(row_id), arg_min(ts, ("at", row_id)), 'genesis', '=>', '{L.GENESIS_DATA}', '{{"actor":"System","engine_version":"1"}}', 0 from ev group by 1),
gi as (select *, {_EID} event_id, 'sha256' algo from gs),
ch as (select ledger_id, seq, prev, {_SELF} self from (select *, '{'0' * 64}' prev from gi where seq = 0)
  union all select ledger_id, seq, prev, {_SELF} from (select gi.*, ch.self prev from gi join ch on ch.ledger_id = gi.ledger_id and gi.seq = ch.seq + 1)),
led as (select * from gi join ch using (ledger_id, seq))"""
_MEM = f"""with {_M}, ob as (select left(sha256(concat(array_to_string(list_sort([event_type, mark]), '|'), '::', otype)), 32) fingerprint, "at", event_id,
  case lvl when 'permanence' then 86400 when 'continuation' then 3600 when 'establishment' then 3600 when 'transformation' then 1800 when 'indication' then 300 when 'emergence' then 60 else 300 end tau0 from mol),
o2 as (select *, first_value(tau0) over (partition by fingerprint order by "at", event_id) tau, row_number() over (partition by fingerprint order by "at", event_id) i,
  count(*) over (partition by fingerprint) n, max(epoch_us("at")) over (partition by fingerprint) lu from ob),
me as (select fingerprint, any_value(tau)::bigint tau, sum((case when i = 1 then 1.0 else 0.2 end) * pow(0.8, n - i) * exp(-(lu - epoch_us("at")) / 1e6 / tau)) weight, count(*)::bigint observation_count, min(epoch_us("at")) created_at, max(lu) last_updated from o2 group by 1),
ag as (select *, weight * exp(-(epoch_us(timestamp '2024-02-01 00:00:00') - last_updated) / 1e6 / tau) w2 from me)"""
_IDX = f"""with {_M}, at0 as (select event_id seq, unnest([event_type, mark]) atom, fsig from mol),
fo as (select atom, fsig, count(*) n, min(seq) seen, max(seq) "last" from at0 group by 1, 2),
ix as (select atom, sum(n)::bigint count_total, max(n) / sum(n) r, arg_min(fsig, (-n, seen)) mode_formula, count(*)::bigint formulas, max("last")::bigint last_seq from fo group by 1)"""
SQL = {
    "f17_event_ids": f"with {_EV} select row_id, {_EID} event_id from ev",
    "st4_ledger": f"{_CHAIN} select ledger_id, seq::bigint seq, event_id, prev, self from led",
    "st7_faults": f"""{_CHAIN}, t0 as (select * exclude (seq, "data", algo), case when seq % 41 = 11 then null else seq end seq, seq line, case when seq % 23 = 7 then '{{}}' else "data" end "data",
  case when seq % 31 = 9 then 'md5' else algo end algo from led where seq % 17 <> 5 or seq % 2 = 0),
t1 as (select *, coalesce(lag(self) over w, '{'0' * 64}') lp, coalesce(lag(seq) over w, -1) + 1 ln from t0 where seq is not null window w as (partition by ledger_id order by line)),
t2 as (select *, sha256(concat(lp, chr(10), {_BODY})) should from t1)
select ledger_id, line::bigint line, 'T861' code from t2 where self <> should union all select ledger_id, line, 'T862' from t2 where prev <> lp union all select ledger_id, line, 'T864' from t2 where seq <> ln
union all select ledger_id, line, 'T865' from t2 where algo <> 'sha256' union all select ledger_id, line, 'T863' from t0 where seq is null""",
    "st1_memory": f"""{_MEM} select fingerprint, tau, case when tau >= 86400 then (tau // 86400) || 'd' when tau >= 3600 then (tau // 3600) || 'h' when tau >= 60 then (tau // 60) || 'm' else tau || 's' end tau_text,
  round(weight, 8) weight, observation_count, created_at, last_updated from me""",
    "st2_aged": f"{_MEM} select fingerprint, round(w2, 8) weight, w2 < 0.01 purge, epoch_us(timestamp '2024-02-01 00:00:00') last_updated from ag",
    "p24_active": f"{_MEM} select fingerprint, round(w2, 8) weight from ag where w2 >= 0.1",
    "a26_memory_stats": f"{_MEM} select count(*)::bigint entries, sum(observation_count)::bigint observations, round(avg(weight), 7) avg_weight, round(max(weight), 7) max_weight, round(min(weight), 7) min_weight from me",
    "a27_rigidity": f"""{_IDX} select atom, count_total, round(r, 8) rigidity, mode_formula, formulas, last_seq, least(count_total, 1000)::bigint frequency,
  case when r >= 0.9 then 'crystallized' when r >= 0.7 then 'rigid' when r >= 0.4 then 'stable' when r >= 0.2 then 'fluid' else 'volatile' end "class",
  case when r > 0.9 then 'disruptive' when r < 0.3 then 'stabilizing' else 'neutral' end strategy, r >= 0.98 and count_total >= 10 alert from ix""",
    "a29_cooccurrence": f"with {_M} select least(event_type, mark) a, greatest(event_type, mark) b, count(*)::bigint n from mol group by 1, 2",
    "a30_directions": f"""with {_M} select count(*)::bigint total, (count(*) filter (direction = '=>+'))::bigint creative, (count(*) filter (direction = '-|>'))::bigint destructive, (count(*) filter (direction = '=>'))::bigint neutral,
  round(avg((direction = '=>+')::int), 8) r_creative, round(avg((direction = '-|>')::int), 8) r_destructive from mol""",
    "t10_related": f"with {_M} select mark other, count(*)::bigint n from mol where event_type = 'view' group by 1 order by n desc, other limit 10",
    "t18_rigid": f"""{_IDX} select * from (select 'rigid' side, atom, round(r, 8) rigidity from ix where count_total >= 2 order by r desc, atom limit 5)
union all select * from (select 'volatile', atom, round(r, 8) from ix where count_total >= 2 order by r, atom limit 5)""",
}
