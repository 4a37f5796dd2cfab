"""Aggregates over audit votes and other repeated judgements: distributions, spreads, drifts, groups, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGH, LOW, HISTORY = 0.5, 0.25, 10


def status_word(status: Column) -> Column:
    """A status without the case, spaces and punctuation it was typed with."""
    return F.nullif(F.regexp_replace(F.lower(status), "[^a-z]", ""), F.lit(""))


def latest_votes(votes: DataFrame) -> DataFrame:
    """One row per key and auditor, the vote with the latest ``voted_at`` (ties by the larger ``vote_id``); a redelivered vote counts once."""
    v = F.struct("vote_id", status_word(F.col("status_suggestion")).alias("status"), "risk_flags", "route_emphasis", "volatility_estimate", "needs_human_review", "profile_id", "voted_at")
    order = F.struct("voted_at", "vote_id")
    ok = votes.filter(F.col("aggregate_key").isNotNull() & F.col("auditor_id").isNotNull())
    return ok.groupBy("aggregate_key", "auditor_id").agg(F.max_by(v, order).alias("v")).select("aggregate_key", "auditor_id", "v.*")


def spread(df: DataFrame, value: str, *by: str, high: float = HIGH, low: float = LOW) -> DataFrame:
    """n, missing, mean, sample deviation, least, most, percentiles 70, 80, 90 (linear), shares at least high and below low."""
    v = F.col(value)
    agg = [
        F.count(v).alias("n"),
        F.count(F.when(v.isNull(), 1)).alias("missing"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("deviation"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
        *[F.percentile(v, p / 100).alias(f"p{p}") for p in (70, 80, 90)],
        F.avg((v >= high).cast("double")).alias("high_rate"),
        F.avg((v < low).cast("double")).alias("low_rate"),
    ]
    return df.groupBy(*by).agg(*agg)


def tally(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def flag_pairs(df: DataFrame, flags: str, k: int | None = 10) -> DataFrame:
    """Pairs of flags set together, most frequent first; pairs are made inside a row, so nothing is joined."""
    s = df.select(F.sort_array(F.array_distinct(F.filter(flags, lambda x: x.isNotNull()))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    g = s.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    return g if k is None else g.orderBy(F.desc("n"), "a", "b").limit(k)


def vote_drift(votes: DataFrame) -> DataFrame:
    """Per key how far its votes differ: votes, statuses, leading status, flags in any, in all, in some only, spread of estimates.

    A flag is in all if every vote of the key carries it; the leading status is the most frequent, the first by name on a
    tie. Flags are counted one by one, so a key with many votes costs a state per flag, not an array of votes.
    """
    key = "aggregate_key"
    n = votes.groupBy(key).agg(
        F.count(F.lit(1)).alias("votes"),
        F.max("volatility_estimate").alias("_hi"),
        F.min("volatility_estimate").alias("_lo"),
        F.count(F.when(F.col("needs_human_review"), 1)).alias("reviews"),
    )
    st = votes.filter("status is not null").groupBy(key, "status").agg(F.count(F.lit(1)).alias("n"))
    st = st.groupBy(key).agg(F.count(F.lit(1)).alias("statuses"), F.min_by("status", F.struct(-F.col("n"), F.col("status"))).alias("lead_status"))
    fl = votes.select(key, F.explode(F.array_distinct("risk_flags")).alias("flag")).groupBy(key, "flag").agg(F.count(F.lit(1)).alias("n"))
    fl = fl.join(n.select(key, "votes"), key).groupBy(key).agg(
        F.sort_array(F.collect_list("flag")).alias("any"), F.sort_array(F.collect_list(F.when(F.col("n") == F.col("votes"), F.col("flag")))).alias("all")
    )
    d = n.join(st, key, "left").join(fl, key, "left")
    none = F.expr("cast(array() as array<string>)")
    joined = lambda c: F.array_join(F.coalesce(c, none), "|")
    return d.select(
        key,
        "votes",
        F.coalesce("statuses", F.lit(0).cast("long")).alias("statuses"),
        "lead_status",
        "reviews",
        joined(F.col("any")).alias("flags_any"),
        joined(F.col("all")).alias("flags_all"),
        joined(F.array_except("any", "all")).alias("flags_conflict"),
        (F.col("_hi") - F.col("_lo")).alias("spread"),
    )


def drift_scores(runs: DataFrame, item: str, outcome: str) -> DataFrame:
    """(distinct outcomes - 1) / (runs - 1) per item, 0 for a single run; null outcomes are outcomes of their own."""
    g = runs.groupBy(item, F.col(outcome).alias("_o")).agg(F.count(F.lit(1)).alias("n")).groupBy(item).agg(F.sum("n").alias("runs"), F.count(F.lit(1)).alias("outcomes"))
    return g.withColumn("drift", F.when(F.col("runs") > 1, (F.col("outcomes") - 1) / (F.col("runs") - 1)).otherwise(0.0))


def like_groups(items: DataFrame, by: list[str], value: str, least: int = 2, k: int = 20) -> DataFrame:
    """Groups of at least ``least`` items alike in ``by``: members, mean and cohesion (1 - deviation, at least 0) of ``value``, largest first."""
    g = items.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_d"))
    g = g.filter(F.col("members") >= least).withColumn("cohesion", F.greatest(F.lit(0.0), 1 - F.col("_d"))).drop("_d")
    return g.orderBy(F.desc("members"), *by).limit(k)


def recent_history(votes: DataFrame, key: str, order: list[str], value: str, n: int = HISTORY) -> DataFrame:
    """Per key its last ``n`` values in order: history, rising (the last above the one before), settled (the last three within 0.1)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
    last = votes.filter(F.col(value).isNotNull()).withColumn("_r", rank).filter(F.col("_r") <= n)
    h = last.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(value).alias("v")))), lambda x: x["v"]).alias("history"))
    tail = F.slice("history", -3, 3)
    settled = F.when(F.size("history") >= 3, F.array_max(tail) - F.array_min(tail) < 0.1)
    rising = F.when(F.size("history") >= 2, F.element_at("history", -1) > F.element_at("history", -2))
    return h.select(key, "history", rising.alias("rising"), settled.alias("settled"))
