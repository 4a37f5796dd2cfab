"""Sinks: JSON lines, keyed folders, and the exports of a report. Row order inside a file is the one documented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.jsonl import TIMES

# Words that a report must not use as labels.
FORBIDDEN_LABELS = (
    "news dialog paper social political economic sports entertainment topic category label type class important "
    "significant relevant recommended suggested best"
).split()


def write_lines(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "overwrite") -> str:
    """JSON lines, sorted by ``order`` over all files if given (ranges, not one task)."""
    (df.orderBy(*order) if order else df).write.mode(mode).option("timestampFormat", TIMES).json(path)
    return path


def append_new(df: DataFrame, path: str, key: str, schema: str) -> int:
    """Appends the rows whose key isn't stored yet, each key once; returns how many."""
    from tidemark.session import written
    from tidemark.sources.jsonl import read_or_empty

    spark = df.sparkSession
    fresh = written(df.dropDuplicates([key]).join(read_or_empty(spark, path, schema).select(key), key, "left_anti"), "fresh")
    fresh.write.mode("append").option("timestampFormat", TIMES).json(path)
    return fresh.count()


def write_w2(stats: DataFrame, path: str, least: int = 1) -> str:
    """Conditional statistics of at least ``least`` counts, by record id."""
    return write_lines(stats.filter(F.col("count") >= least), path, ["record_id"])


def write_by(df: DataFrame, path: str, key: str) -> str:
    """One folder per value of ``key``; rows of a value are gathered first, so it gets one file unless it is heavy."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).option("timestampFormat", TIMES).json(path)
    return path


def fixed(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", c)


def islands_csv(islands: DataFrame) -> DataFrame:
    """Lines of islands.csv by island: island_id, size, cohesion at six places."""
    return islands.select("scope", "island_id", "size", fixed(F.col("cohesion"), 6).alias("cohesion")).orderBy("scope", "island_id")


def topology_csv(pairs: DataFrame) -> DataFrame:
    """Lines of topology.csv by pair: distance at twelve places."""
    return pairs.select("scope", "pair_id", "island_a", "island_b", fixed(F.col("distance"), 12).alias("distance")).orderBy("scope", "pair_id")


def evidence_csv(evidence: DataFrame) -> DataFrame:
    """Lines of evidence.csv by island, then signed score from the largest, then token: score at eight places."""
    return evidence.orderBy("scope", "first", F.desc("score"), "token").select("scope", "first", "token", fixed(F.col("score"), 8).alias("score"), "presence")


def members_csv(membership: DataFrame) -> DataFrame:
    return membership.filter("in_island").select("scope", "first", "article_id").orderBy("scope", "first", "article_id")


def write_csv(df: DataFrame, path: str) -> str:
    """One CSV file with a header; for reports, whose size is that of the islands, not of the articles."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def report_markdown(observation: DataFrame, islands: DataFrame, evidence: DataFrame, k: int = 10) -> DataFrame:
    """scope and text of a report per scope: its islands by size with cohesion and leading evidence."""
    e = evidence.filter(F.col("rank") <= k).groupBy("scope", "first").agg(F.sort_array(F.collect_list(F.struct("rank", "token", "score"))).alias("_e"))
    tokens = F.array_join(F.transform("_e", lambda x: F.concat(F.lit("- "), x["token"], F.lit(" ("), F.format_string("%.8f", x["score"]), F.lit(")"))), "\n")
    i = islands.join(e, ["scope", "first"], "left")
    part = F.concat(F.lit("## "), F.col("island_id"), F.lit("\n\nSize: "), F.col("size").cast("string"), F.lit("\nCohesion: "), fixed(F.col("cohesion"), 6), F.lit("\n\n"), F.coalesce(tokens, F.lit("")))
    body = i.withColumn("_p", part).groupBy("scope").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("n"), "island_id", "_p"))), lambda x: x["_p"]).alias("_b"))
    o = observation.join(body, "scope", "left")
    head = F.concat(F.lit("# Observation "), F.col("observation_id"), F.lit("\n\nIslands: "), F.col("island_count").cast("string"), F.lit("\nNoise: "), F.col("noise_count").cast("string"), F.lit("\n\n"))
    return o.select("scope", F.concat(head, F.coalesce(F.array_join("_b", "\n\n"), F.lit(""))).alias("text"))


def names_nothing(text: Column) -> Column:
    """Whether a report stays free of labels that judge."""
    low = F.lower(text)
    found = low.contains(FORBIDDEN_LABELS[0])
    for w in FORBIDDEN_LABELS[1:]:
        found = found | low.contains(w)
    return ~found


def same_each_time(make, paths: list[str], spark) -> bool:
    """Whether ``make(path)`` writes the same rows to every path: digests of the sorted lines are compared."""
    seen = set()
    for p in paths:
        make(p)
        d = spark.read.text(p)
        seen.add(d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("h")).first())
    return len(seen) == 1
