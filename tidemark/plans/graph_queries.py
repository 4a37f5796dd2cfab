"""Queries of dynamics over events, of edges over embeddings, and of word readings over stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import routing as R
from tidemark.operators import dynamics as D
from tidemark.operators import edges as E
from tidemark.operators.words import typo_candidates
from tidemark.plans.text_sql import STOP_SQL, lit
from tidemark.functions.text import TYPO_WORDS
from tidemark.session import table

OPPOSITE = {"view": "click", "click": "view", "purchase": "signup", "signup": "purchase", "error": "error"}
CONFLICTS = [("template_risk", "title_like"), ("entity_ambiguous", "typo_plausible"), ("source_conflict", "title_like")]


def wn3_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return D.smoothed(e, "event_type", ["ts", "event_id"], "value").select("event_type", "n", F.round("value", 7).alias("value"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return D.links(e, "user_id", ["ts", "event_id"], "event_type", "at")


def wn2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of event types per user, and their weight at the first of February."""
    now = F.lit(1706745600.0)
    w = D.link_weight(F.col("count"), now - F.unix_micros("last_seen") / 1e6)
    return _links(spark, sf_dir).select("user_id", "a", "b", "count", F.unix_micros("last_seen").alias("last_seen"), F.round(w, 7).alias("weight"))


def wn5_link_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.struct("user_id", "event_type"))
    v = e.groupBy("user_id", "event_type").agg(F.avg(F.col("value") / 100).alias("value"))
    return D.link_errors(_links(spark, sf_dir), v, "user_id", "event_type", F.lit(1706745600.0))


def st19_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    axis = F.element_at(F.array(*map(F.lit, ["interconnection", "symmetry", "value_generation", "temporal"])), (k % 4 + 1).cast("int"))
    level = F.element_at(F.array(*map(F.lit, ["independent", "destructive", "resonant", "generative", "other"])), (k % 5 + 1).cast("int"))
    o = e.select("user_id", "event_id", F.col("event_type").alias("concept"), axis.alias("axis"), level.alias("level"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), F.round((k % 5 + 1) / 5, 2).alias("level_score"))
    return D.engine(o, "user_id", ["event_id"], OPPOSITE, ("error",))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return E.concept_edges(v, "vec_id", "embedding", E.centres(v, "label", "embedding"), "label", 0.05, 10)


def j15_concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every vector to the centres of all labels with softmax weights."""
    return E.weighted(_edges(spark, sf_dir), "vec_id").select("vec_id", "label", F.round("raw_score", 7).alias("raw_score"), F.round("weight", 6).alias("weight"))


def t14_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three labels' best vectors for each label: at most one vector of a label among a label's neighbours."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("own"))
    c = _edges(spark, sf_dir).join(v, "vec_id").filter("own <> label").withColumn("score", F.round("raw_score", 9))
    d = E.diverse_top(c, "label", "own", "score", "vec_id", 3)
    return d.select("label", F.col("rank").cast("long").alias("rank"), "vec_id", "own")


def a61_most_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.most_hit(_edges(spark, sf_dir), "vec_id", None)


def a22_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels ranked for each user, whose events point to vectors."""
    n = 500
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("text"), F.col("event_type").alias("token"), (F.get_json_object("props", "$.k").cast("long") * 7 % n).alias("vec_id")).distinct()
    c = E.concept_scores(t, E.weighted(_edges(spark, sf_dir), "vec_id"), "vec_id", "label")
    return c.select("text", F.col("rank").cast("long").alias("rank"), "label", F.round("score", 4).alias("score"), "tokens")


def h7_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored word with the scores of its readings, the decision, and how much they conflict."""
    r = table(spark, sf_dir, "w2_records").filter("token_norm is not null")
    w = r.groupBy(F.col("token_norm").alias("word")).agg(F.sum(F.coalesce("doc_freq", F.lit(0))).alias("docs"), F.min("top_surface_form").alias("surface"), F.count_distinct("condition_signature").alias("conds"))
    typo = typo_candidates(w.select("word").filter(F.col("word").rlike("^[ -~]+$")), "word").select("word", F.when(F.col("suggestion").isNotNull(), F.col("confidence")).alias("typo"))
    x = w.join(typo, "word", "left").withColumn("f", R.context_flags(F.coalesce("surface", F.lit(""))))
    s = R.route_scores(F.col("typo"), F.col("word").contains(" "), F.col("conds") > 50, F.col("f.capitalized"), F.col("f.quoted"), F.col("docs") > 2, F.col("conds") > 5, F.col("word"))
    x = x.select("word", s.alias("s")).withColumns({"d": R.decision(F.col("s")), "c": R.sense_conflict(F.col("s")).cast("double"), "n": R.competing(F.col("s"))})
    text = F.array_join(F.transform("s", lambda v: F.round(v * 1000).cast("int").cast("string")), "|")
    return x.select("word", text.alias("scores"), F.col("d.winner").alias("winner"), F.round("d.margin", 6).alias("margin"), F.round("d.entropy", 6).alias("entropy"), F.round("c", 3).alias("conflict"), F.col("n").cast("long").alias("competing"))


def h14_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key how far the flags of two profiles of auditors contradict each other, and the resulting volatility."""
    v = table(spark, sf_dir, "audit_votes_7cprime").filter("aggregate_key is not null")
    of = lambda p: F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("profile_id") == p, F.col("risk_flags"))))))
    g = v.groupBy("aggregate_key").agg(of("AUDIT_BALANCED").alias("x"), of("AUDIT_CONSERVATIVE").alias("y"), of("AUDIT_EXPLORATORY").alias("z"))
    c = R.source_conflict(F.col("x"), F.col("y"), CONFLICTS)
    g = g.select("aggregate_key", c.alias("c"), R.dispersion(F.array_union("x", F.array_union("y", "z"))).alias("d"), F.size("z").alias("n"))
    vol = R.volatility(F.lit(0.5), F.col("c"), F.col("d"))
    return g.select("aggregate_key", F.round("c", 6).alias("conflict"), F.col("d").cast("double").alias("dispersion"), vol.alias("volatility"), R.band(vol, F.col("n")).alias("band"))


def u7_first_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each url once, with the article that came first."""
    a = table(spark, sf_dir, "articles").filter("source_url is not null")
    return a.groupBy("source_url").agg(F.min_by("article_id", F.struct(F.coalesce(F.unix_micros("ingestion_time"), F.lit(2**62)), "article_id")).alias("article_id"), F.count(F.lit(1)).alias("times"))


def st14_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as a queue: how often each came in, first and last when."""
    r = table(spark, sf_dir, "w2_records").filter("token_norm is not null")
    return r.groupBy("token_norm").agg(F.count(F.lit(1)).alias("times"), F.unix_micros(F.min("updated_at")).alias("first_seen"), F.unix_micros(F.max("updated_at")).alias("last_seen"))


def nd2_text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain facts of whole texts: characters, words, lines, signs, spaces, and the parts of the time of publication."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    words = F.size(F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != ""))
    return d.select(
        "doc_id",
        F.length("text").cast("long").alias("chars"),
        words.cast("long").alias("words"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"),
        F.col("text").rlike("[0-9]").alias("has_numbers"),
        F.col("text").rlike("[.!?]").alias("has_punctuation"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[ \t\n\r\f]", ""))).cast("long").alias("spaces"),
        F.year("published_at").cast("long").alias("year"),
        F.weekday("published_at").cast("long").alias("weekday"),
        F.hour("published_at").cast("long").alias("hour"),
    )


QUERIES = {
    f.__name__: f
    for f in (wn3_smoothed, wn2_links, wn5_link_errors, st19_engine, j15_concept_edges, t14_diverse, a61_most_hit, a22_candidates, h7_readings, h14_conflicts, u7_first_by_url, st14_queue, nd2_text_facts)
}
_LINKS = """o as (select *, row_number() over (partition by user_id order by ts, event_id) n from events),
lk as (select x.user_id, least(x.event_type, y.event_type) a, greatest(x.event_type, y.event_type) b, count(*)::bigint "count", max(epoch_us(x.ts)) last_seen
  from o x join o y on x.user_id = y.user_id and y.n between x.n - 5 and x.n - 1 and x.event_type <> y.event_type group by 1, 2, 3),
lw as (select *, 0.7 * ln(1 + "count") + 0.3 * exp(-greatest(1706745600.0 - last_seen / 1e6, 0) / 86400.0) w from lk)"""
_EDGES = """cx as (select label, i, avg(x::double) x from (select label, unnest(embedding) x, unnest(range(len(embedding))) i from embeddings where label is not null) group by 1, 2),
vx as (select vec_id, unnest(embedding)::double x, unnest(range(len(embedding))) i from embeddings),
cn as (select label, sqrt(sum(x * x)) n from cx group by 1), vn as (select vec_id, sqrt(sum(x * x)) n from vx group by 1),
ds as (select vec_id, label, sum(vx.x * cx.x) d from vx join cx using (i) group by 1, 2),
ed as (select * from (select vec_id, label, round(d / (vn.n * cn.n), 12) raw_score, row_number() over (partition by vec_id order by round(d / (vn.n * cn.n), 12) desc, label) k
  from ds join vn using (vec_id) join cn using (label) where round(d / (vn.n * cn.n), 12) >= 0.05) where k <= 10)"""
_TYPO = "[" + ", ".join(map(lit, sorted(TYPO_WORDS))) + "]"
SQL = {
    "wn3_smoothed": """with o as (select *, count(*) over w n, row_number() over (partition by event_type order by ts, event_id) i from events where "value" is not null window w as (partition by event_type))
select event_type, any_value(n)::bigint n, round(sum(0.3 * pow(0.7, n - i) * "value"), 7) "value" from o group by 1""",
    "wn2_links": f"with {_LINKS} select user_id, a, b, \"count\", last_seen, round(w, 7) weight from lw",
    "wn5_link_errors": f"""with {_LINKS}, v as (select user_id, event_type, avg("value" / 100) v from events group by 1, 2), b2 as (select user_id, a x, b y, w from lw union all select user_id, b, a, w from lw)
select b2.user_id, x event_type, round(avg(w * pow(p.v - q.v, 2)), 4) error, count(*)::bigint linked from b2 join v p on p.user_id = b2.user_id and p.event_type = x join v q on q.user_id = b2.user_id and q.event_type = y group by 1, 2""",
    "j15_concept_edges": f"""with {_EDGES} select vec_id, label, round(raw_score, 7) raw_score,
  round(exp((raw_score - max(raw_score) over w) / 0.1) / sum(exp((raw_score - m) / 0.1)) over w, 6) weight from (select *, max(raw_score) over (partition by vec_id) m from ed) window w as (partition by vec_id)""",
    "t14_diverse": f"""with {_EDGES}, c as (select ed.vec_id, ed.label, e.label own, round(raw_score, 9) s from ed join embeddings e using (vec_id) where e.label <> ed.label),
g as (select *, row_number() over (partition by label, own order by s desc, vec_id) g from c), r as (select *, row_number() over (partition by label order by s desc, vec_id) r from g where g = 1)
select label, r "rank", vec_id, own from r where r <= 3""",
    "a61_most_hit": f"with {_EDGES} select vec_id, count(*)::bigint hits from ed group by 1",
    "a22_candidates": f"""with {_EDGES}, ew as (select *, exp((raw_score - m) / 0.1) / sum(exp((raw_score - m) / 0.1)) over (partition by vec_id) weight from (select *, max(raw_score) over (partition by vec_id) m from ed)),
t as (select distinct user_id "text", event_type token, (props->>'$.k')::bigint * 7 % 500 vec_id from events),
g as (select "text", label, sum(round(raw_score * weight, 8)) score, count(distinct token)::bigint tokens from t join ew using (vec_id) group by 1, 2)
select "text", r "rank", label, round(score, 4) score, tokens from (select *, row_number() over (partition by "text" order by round(score, 9) desc, label) r from g) where r <= 5""",
    "h7_readings": f"""with w as (select token_norm word, sum(coalesce(doc_freq, 0)) docs, min(top_surface_form) surface, count(distinct condition_signature) conds from w2_records where token_norm is not null group by 1),
ty as (select word, levenshtein(word, r) d, r, abs(length(word) - length(r)) g, greatest(length(word), length(r)) m from w, (select unnest({_TYPO}) r) where length(word) >= 3 and regexp_matches(word, '^[ -~]+$')),
t2 as (select word, arg_min(case when d = 1 and g <= 1 then 0.85 - 0.1 * g else (1 - d / 3.0) * (1 - g / m) end, (d, r)) conf from ty where d between 1 and 2 group by 1),
f as (select w.*, case when conf >= 0.7 then round(conf::double, 3) end typo, list_filter(regexp_split_to_array(coalesce(surface, ''), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '') ws from w left join t2 using (word)),
s as (select word, [round(case when typo is null then 0.0 else greatest(0, least(1, typo - case when contains(word, ' ') then 0.15 else 0 end)) end, 3),
  round(least(1.0, 0.3 + case when docs > 2 and conds > 50 then 0.25 else 0 end + case when contains(word, ' ') then 0.2 else 0 end + case when len(ws) > 0 and len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) / len(ws) > 0.5 then 0.2 else 0 end
    + case when regexp_matches(coalesce(surface, ''), '["''「」]') then 0.2 else 0 end), 3),
  case when docs <= 2 then 0.6 when conds <= 5 then 0.35 else 0.15 end, case when lower(word) in ({STOP_SQL}) or length(word) < 2 then 0.9 else 0.05 end]::double[] s from f),
p as (select word, s, list_sum(s) t, list_reverse_sort(s) z, len(list_filter(s, lambda x: x >= 0.15)) n from s),
q as (select *, (z[1] - z[2]) / t m, -list_sum([case when x > 0 then x / t * ln(x / t) else 0 end for x in s]) e from p)
select word, array_to_string([round(x * 1000)::int::varchar for x in s], '|') scores, case when m >= 0.2 and e <= 0.9 then ['A', 'B', 'C', 'D'][list_position(s, z[1])] end winner, round(m, 6) margin, round(e, 6) entropy,
  round(case when n < 2 then 0.1 else least(1.0, case when z[1] - z[2] < 0.10 then 0.9 when z[1] - z[2] < 0.15 then 0.7 when z[1] - z[2] < 0.25 then 0.5 when z[1] - z[2] < 0.35 then 0.3 else 0.1 end + case when n >= 3 then 0.2 else 0 end) end::double, 3) conflict, n::bigint competing from q""",
    "h14_conflicts": """with f as (select aggregate_key, profile_id, unnest(risk_flags) x from audit_votes_7cprime where aggregate_key is not null), k as (select distinct aggregate_key from audit_votes_7cprime where aggregate_key is not null),
g as (select k.aggregate_key, coalesce(list_distinct(list(x) filter (profile_id = 'AUDIT_BALANCED')), []) x, coalesce(list_distinct(list(x) filter (profile_id = 'AUDIT_CONSERVATIVE')), []) y, coalesce(list_distinct(list(x) filter (profile_id = 'AUDIT_EXPLORATORY')), []) z from k left join f using (aggregate_key) group by 1),
h as (select *, list_distinct(x || y) u, list_intersect(x, y) i, len(list_distinct(x || y || z)) a from g),
c as (select aggregate_key, len(z) n, case when len(x) = 0 or len(y) = 0 then 0.1 else least(1.0,
  case when (list_contains(x, 'template_risk') and list_contains(y, 'title_like')) or (list_contains(y, 'template_risk') and list_contains(x, 'title_like')) then 0.3 else 0 end
  + case when (list_contains(x, 'entity_ambiguous') and list_contains(y, 'typo_plausible')) or (list_contains(y, 'entity_ambiguous') and list_contains(x, 'typo_plausible')) then 0.3 else 0 end
  + case when (list_contains(x, 'source_conflict') and list_contains(y, 'title_like')) or (list_contains(y, 'source_conflict') and list_contains(x, 'title_like')) then 0.3 else 0 end
  + 0.4 * (len(u) - len(i)) / len(u)) end::double c, case when a >= 6 then 0.7 when a >= 4 then 0.5 when a >= 2 then 0.3 else 0.1 end::double d from h),
v as (select *, round(0.25 + 0.3 * c + 0.2 * d, 3) vol from c)
select aggregate_key, round(c, 6) conflict, d dispersion, vol::double volatility, case when vol >= 0.5 then 'quarantine' when vol >= 0.25 or n >= 2 then 'defer' else 'candidate' end band from v""",
    "u7_first_by_url": "select source_url, arg_min(article_id, (coalesce(epoch_us(ingestion_time), 4611686018427387904), article_id)) article_id, count(*)::bigint times from articles where source_url is not null group by 1",
    "st14_queue": "select token_norm, count(*)::bigint times, epoch_us(min(updated_at)) first_seen, epoch_us(max(updated_at)) last_seen from w2_records where token_norm is not null group by 1",
    "nd2_text_facts": r"""select doc_id, length(text)::bigint chars, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> ''))::bigint words, (length(text) - length(replace(text, chr(10), '')) + 1)::bigint lines,
  regexp_matches(text, '[0-9]') has_numbers, regexp_matches(text, '[.!?]') has_punctuation, (length(text) - length(regexp_replace(text, '[ \t\n\r\f]', '', 'g')))::bigint spaces,
  year(published_at at time zone 'UTC')::bigint "year", (isodow(published_at at time zone 'UTC') - 1)::bigint "weekday", hour(published_at at time zone 'UTC')::bigint "hour" from documents where text is not null""",
}
