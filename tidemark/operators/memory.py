"""Decaying memory: weights that fade with time and are renewed by every observation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scores import ALPHA, FORGET, decayed
from tidemark.operators.skew import fold_by_range
from tidemark.session import written


def replay(observations: DataFrame, alpha: float = ALPHA, partitions: int | None = None) -> DataFrame:
    """The memory after all observations: fingerprint, tau, weight, observation_count, created_at, last_updated.

    ``observations``: fingerprint, at (timestamp), event_id, tau. A new entry has weight 1 and the tau of its first
    observation; each later one lets the weight decay and then reinforces it. That recurrence is affine, so a stretch
    of observations is one state (count, first, last, gathered weight) and neighbouring stretches join exactly: keys
    are cut by range where one holds many rows. Times are taken in order (ties by event_id); null times or
    fingerprints are left out; an empty input gives no row.
    """
    # The log is read, and its fingerprints made, once.
    o = written(observations.select("fingerprint", "at", "event_id", "tau").filter(F.col("fingerprint").isNotNull() & F.col("at").isNotNull()), "observed")
    tau = o.groupBy("fingerprint").agg(F.min_by("tau", F.struct("at", "event_id")).cast("double").alias("tau"))
    rows = o.select("fingerprint", (F.unix_micros("at")).alias("us"), "event_id").join(tau, "fingerprint")

    def fold(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
        us = t.column("us").to_numpy()
        tau = t.column("tau").to_numpy()
        size = ends - starts
        last = np.repeat(us[ends - 1], size)
        later = np.repeat(ends - 1, size) - np.arange(len(us))
        part = alpha * (1 - alpha) ** later * np.exp(-(last - us) / 1e6 / tau)
        cols = {
            "n": pa.array(size, pa.int64()),
            "first_us": pa.array(us[starts]),
            "last_us": pa.array(us[ends - 1]),
            "gathered": pa.array(np.add.reduceat(part, starts)),
            "tau": pa.array(tau[starts]),
        }
        return pa.table({"fingerprint": t.column("fingerprint").take(pa.array(starts)), **cols})

    def merge(a: dict, b: dict) -> dict:
        keep = (1 - alpha) ** b["n"] * np.exp(-(b["last_us"] - a["last_us"]) / 1e6 / b["tau"])
        return {"n": a["n"] + b["n"], "first_us": a["first_us"], "last_us": b["last_us"], "gathered": float(a["gathered"] * keep + b["gathered"]), "tau": b["tau"]}

    s = fold_by_range(rows, ["fingerprint"], ["us", "event_id"], "n long, first_us long, last_us long, gathered double, tau double", fold, merge, partitions)
    # The first observation gives 1, not alpha: what it has beyond alpha fades with the rest.
    head = F.pow(F.lit(1 - alpha), F.col("n")) * F.exp(-(F.col("last_us") - F.col("first_us")) / 1e6 / F.col("tau"))
    return s.select(
        "fingerprint", "tau", (F.col("gathered") + head).alias("weight"), F.col("n").alias("observation_count"), F.timestamp_micros("first_us").alias("created_at"), F.timestamp_micros("last_us").alias("last_updated")
    )


def aged(memory: DataFrame, now: Column) -> DataFrame:
    """The memory at a later time, with ``purge`` for what is then forgotten (a time before the last update changes nothing)."""
    seconds = (F.unix_micros(now) - F.unix_micros("last_updated")) / 1e6
    weight = F.when(seconds > 0, decayed(F.col("weight"), seconds, F.col("tau"))).otherwise(F.col("weight"))
    # All three from the old row at once: the new update time must not change the time passed.
    return memory.withColumns({"weight": weight, "last_updated": F.when(seconds > 0, now).otherwise(F.col("last_updated")), "purge": (seconds > 0) & (weight < FORGET)})


def active(memory: DataFrame, least: float = 0.1) -> DataFrame:
    """Entries of at least some weight, heaviest first."""
    return memory.filter(F.col("weight") >= least).orderBy(F.desc("weight"), "fingerprint")


def memory_stats(memory: DataFrame) -> DataFrame:
    return memory.agg(F.count(F.lit(1)).alias("entries"), F.sum("observation_count").alias("observations"), F.avg("weight").alias("avg_weight"), F.max("weight").alias("max_weight"), F.min("weight").alias("min_weight"))
