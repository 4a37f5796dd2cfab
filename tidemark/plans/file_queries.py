"""Round trips through files and streams: what is written and read again, or streamed, must equal the tables it came from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import segment as G
from tidemark.plans import event_queries as EV
from tidemark.plans import island_queries as I
from tidemark.plans import stats_queries as ST
from tidemark.plans.registry_queries import SQL as REGISTRY_SQL
from tidemark.plans.registry_queries import _contexts
from tidemark.plans.segment_queries import SQL as SEGMENT_SQL
from tidemark.session import shared_dir, table, written
from tidemark.sources import jsonl as J
from tidemark.sources import sinks as K
from tidemark.streaming import observe as O


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def sc1_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written as JSON files and read back by the article scan."""
    a = table(spark, sf_dir, "articles").select("article_id", "source_url", "source_meta", "ingestion_time").withColumn("text", F.lit("t"))
    path = K.write_lines(a, _path(spark, "articles"))
    d = J.read_lines(spark, path, J.ARTICLE)
    return d.select("article_id", "source_url", F.size(F.map_keys("source_meta")).cast("long").alias("keys"), F.unix_micros("ingestion_time").alias("ingestion_us"))


def sk2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional statistics of two counts or more, saved by record id and loaded again."""
    w2 = ST.a5_condition_stats(spark, sf_dir)
    return J.read_or_empty(spark, K.write_w2(w2, _path(spark, "w2"), 2), J.W2)


def sk3_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specific tokens saved in one folder per condition; one folder is read back by pruning."""
    top = ST.w3_of_records(spark, sf_dir)
    path = K.write_by(top, _path(spark, "w3"), "cond")
    d = spark.read.schema("side string, rank long, token_norm string, s_score double, count long, count_all long, cond string").json(path)
    return d.groupBy("cond", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))


def sk14_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written as lines, read again and validated: no row is the wished result but the count of entries."""
    from tidemark.operators import ledger as L

    d = L.chained(L.with_genesis(EV._events(spark, sf_dir)))
    out = d.select("v", "ledger_id", "seq", "ts", "event_type", "direction", "data", "meta", F.struct("algo", "prev", "event_id", "self").alias("hash"))
    back = J.read_lines(spark, K.write_lines(out, _path(spark, "ledger")), J.LEDGER)
    back = back.select("v", "ledger_id", "seq", "ts", "event_type", "direction", "data", "meta", "hash.*", F.col("seq").alias("line"))
    bad = L.faults(back).groupBy("ledger_id").agg(F.count(F.lit(1)).alias("faults"))
    return back.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("entries")).join(bad, "ledger_id", "left").withColumn("faults", F.coalesce("faults", F.lit(0).cast("long")))


def sk15_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts appended in two goes to a registry file: each is stored once."""
    c = written(_contexts(spark, sf_dir).select("context_id", "traces", "retrieval_path"), "contexts")
    path = _path(spark, "registry")
    K.append_new(c.filter(F.col("context_id") < "8"), path, "context_id", J.CONTEXT)
    K.append_new(c, path, "context_id", J.CONTEXT)
    return J.read_lines(spark, path, J.CONTEXT).select("context_id", "retrieval_path")


def sk8_islands_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = K.write_csv(K.islands_csv(I._done(spark, sf_dir).islands()), _path(spark, "islands"))
    return spark.read.option("header", True).schema("scope string, island_id string, size long, cohesion string").csv(path)


def sk9_topology_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.topology_csv(I._done(spark, sf_dir).topology()).withColumn("distance", F.round(F.col("distance").cast("double"), 8))


def sk11_members_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.members_csv(I._done(spark, sf_dir).membership)


def sk7_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown reports of all scopes."""
    done = I._done(spark, sf_dir)
    from tidemark.operators import stats as S

    e = done.evidence(S.specific_tokens(S.scored(ST.stored_counts(spark, sf_dir))))
    return K.report_markdown(done.observations(), done.islands(), e).withColumn("names_nothing", K.names_nothing(F.col("text")))


def _stream(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = _path(spark, name)
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def st9_stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of atoms and formulas gathered by a stream of events."""
    m = EV.molecules(spark, sf_dir).select("seq", "atoms", "formula_signature")
    return O.drained(O.formula_counts_stream(_stream(spark, m, "molecules")), "update", ["atom", "formula_signature"])


def st1_stream_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory kept by a stateful stream over the log, which comes in order of time."""
    o = EV._observed(spark, sf_dir).select("fingerprint", F.unix_micros("at").alias("us"), "event_id", "tau")
    path = _path(spark, "log")
    # The log of a day is one batch, as files of a ledger follow each other.
    days = o.withColumn("day", F.floor(F.col("us") / (10 * 86400 * 10**6)))
    for d in sorted(r[0] for r in days.select("day").distinct().collect()):
        days.filter(F.col("day") == d).drop("day").coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(path)
    m = O.drained(O.memory_stream(s), "update", ["fingerprint"], "observation_count")
    return m.select("fingerprint", F.round("weight", 8).alias("weight"), "observation_count", "created_us", "updated_us")


def st15_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue entries (type and number of an event) that a stream lets through once."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("|", "event_type", F.get_json_object("props", "$.k")).alias("key"), F.col("ts").cast("timestamp").alias("at"))
    d = O.drained(O.first_per_key_stream(_stream(spark, e, "queue"), "key", "at", "60 days"), "append")
    return d.select("key").distinct()


def p08_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs cut again from their articles by their spans."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = G.paragraphs(d, "text").select("doc_id", "start", "end")
    return p.join(d, "doc_id").select("doc_id", F.col("start").cast("long").alias("start"), F.md5(G.slice_of(F.col("text"), F.col("start"), F.col("end"))).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (sc1_articles, sk2_statistics, sk3_by_condition, sk14_ledger, sk15_registry, sk8_islands_csv, sk9_topology_csv, sk11_members_csv, sk7_reports, st9_stream_index, st1_stream_memory, st15_stream_dedup, p08_slices)
}
SQL = {
    "sc1_articles": "select article_id, source_url, cardinality(source_meta)::bigint keys, epoch_us(ingestion_time) ingestion_us from articles",
    "sk2_statistics": f'select record_id, token_norm, cond, "count", doc_freq, entropy, top_form from ({ST.SQL["a5_condition_stats"]}) where "count" >= 2',
    "sk3_by_condition": f'select cond, side, count(*)::bigint n, sum("count")::bigint total from ({ST.SQL["w3_of_records"]}) group by 1, 2',
    "sk14_ledger": "select 'user-' || user_id ledger_id, (count(*) + 1)::bigint entries, 0::bigint faults from events group by 1",
    "sk15_registry": f"select context_id, retrieval_path from ({REGISTRY_SQL['u9_registry']})",
    "sk8_islands_csv": f"select scope, island_id, size, printf('%.6f', cohesion) cohesion from ({I.SQL['w5_islands']})",
    "sk9_topology_csv": f"select scope, pair_id, island_a, island_b, distance from ({I.SQL['t8_topology']})",
    "sk11_members_csv": f'select scope, "first", article_id from ({I.SQL["w5_membership"]}) where in_island',
    "st9_stream_index": f"{EV._IDX} select atom, fsig formula_signature, n::bigint n, seen, \"last\" from fo",
    "st1_stream_memory": f"{EV._MEM} select fingerprint, round(weight, 8) weight, observation_count, created_at created_us, last_updated updated_us from me",
    "st15_stream_dedup": "select distinct event_type || '|' || (props->>'$.k') \"key\" from events",
    "p08_slices": f'select doc_id, "start", digest from ({SEGMENT_SQL["p03_paragraphs"]})',
}
