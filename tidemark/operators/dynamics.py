"""Dynamics of observed concepts: smoothed values, links of neighbouring observations, and the full ordered engine."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import link_weight
from tidemark.operators.scan import scan_by_key
from tidemark.operators.skew import fold_by_range

# Fixed values of the engine.
GAMMA, CONTEXT, TAU = 0.3, 5, 86400.0
HIGH, NEAR, DISSOLVE, BOOST = 0.5, 0.3, 0.1, 1.5


def smoothed(df: DataFrame, key: str, order: list[str], value: str, gamma: float = GAMMA, partitions: int | None = None) -> DataFrame:
    """key, n, value: exponential smoothing from 0 over each key's values in order (null values are left out).

    A stretch of values is an affine map, and neighbouring stretches join, so a heavy key is split by range.
    """
    rows = df.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, *order, F.col(value).cast("double").alias("_x"))

    def fold(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
        x = t.column("_x").to_numpy()
        later = np.repeat(ends - 1, ends - starts) - np.arange(len(x))
        v = np.add.reduceat(gamma * (1 - gamma) ** later * x, starts)
        return pa.table({key: t.column(key).take(pa.array(starts)), "n": pa.array(ends - starts, pa.int64()), "value": pa.array(v)})

    def merge(a: dict, b: dict) -> dict:
        return {"n": a["n"] + b["n"], "value": a["value"] * (1 - gamma) ** b["n"] + b["value"]}

    return fold_by_range(rows, [key], order, "n long, value double", fold, merge, partitions)


def links(df: DataFrame, by: str, order: list[str], concept: str, time: str, window: int = CONTEXT) -> DataFrame:
    """by, a, b, count, last_seen: how often two concepts stood within ``window`` observations of each other.

    Each observation meets the ones right before it; a repeat of its own concept makes no link.
    """
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-window, -1)
    d = df.select(by, concept, time, F.collect_list(concept).over(w).alias("_c"))
    e = d.select(by, time, F.col(concept).alias("x"), F.explode("_c").alias("y")).filter("x <> y")
    return e.groupBy(by, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("count"), F.max(time).alias("last_seen"))


def link_errors(links_: DataFrame, values: DataFrame, by: str, concept: str, now_seconds, tau: float = TAU) -> DataFrame:
    """by, concept, error, linked: mean weighted squared difference of a concept's value to those it is linked with (4 places)."""
    half = lambda x, y: links_.select(by, F.col(x).alias(concept), F.col(y).alias("_o"), "count", "last_seen")
    both = half("a", "b").unionByName(half("b", "a"))
    v = values.select(by, concept, F.col("value").alias("_v"))
    j = both.join(v, [by, concept]).join(v.select(by, F.col(concept).alias("_o"), F.col("_v").alias("_w")), [by, "_o"])
    weight = link_weight(F.col("count"), now_seconds - F.unix_micros("last_seen") / 1e6, tau)
    return j.groupBy(by, concept).agg(F.round(F.avg(weight * F.pow(F.col("_v") - F.col("_w"), 2)), 4).alias("error"), F.count(F.lit(1)).alias("linked"))


def catalyst(concept: str, axis: str, level: str, destructive: Iterable[str]) -> str:
    """What an observation does to a saturated pair."""
    if (axis, level) in (("interconnection", "independent"), ("symmetry", "destructive")) or concept in destructive:
        return "destructive"
    if (axis, level) in (("interconnection", "resonant"), ("symmetry", "generative")) or axis == "value_generation":
        return "creative"
    return "none"


def engine(observations: DataFrame, by: str, order: list[str], opposite: dict[str, str], destructive: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """Every observation's outcome in order: n, value, pair_value, link_error, weight, emergence.

    ``observations``: ``by``, ``order``, concept, axis, level, seconds, level_score. State per ``by``: smoothed values,
    links and the last five concepts, so it is bounded by the concepts, not by the observations. If the opposites of a
    pair in the context are both high and near, a destructive observation dissolves them.
    """

    def step(state: dict | None, r: dict) -> tuple[dict, dict]:
        s = state or {"n": 0, "value": {}, "count": {}, "links": {}, "recent": []}
        c, now = r["concept"], r["seconds"]
        kind, boost = "none", 1.0
        pairs = sorted({tuple(sorted((x, opposite[x]))) for x in s["recent"] if opposite.get(x) in s["recent"] and opposite[x] != x})
        if len(s["recent"]) >= 2 and pairs:
            a, b = max(pairs, key=lambda p: (s["value"].get(p[0], 0.0) + s["value"].get(p[1], 0.0)))
            va, vb = s["value"].get(a, 0.0), s["value"].get(b, 0.0)
            if va > HIGH and vb > HIGH and abs(va - vb) < NEAR:
                kind = catalyst(c, r["axis"], r["level"], destructive)
                if kind == "destructive":
                    s["value"][a], s["value"][b], boost = va * DISSOLVE, vb * DISSOLVE, BOOST
        s["n"] += 1
        s["count"][c] = s["count"].get(c, 0) + 1
        v = s["value"][c] = (1 - GAMMA) * s["value"].get(c, 0.0) + GAMMA * boost
        for o in s["recent"]:
            if o != c:
                k = tuple(sorted((o, c)))
                s["links"][k] = (s["links"].get(k, (0, 0.0))[0] + 1, now)
        s["recent"] = [*s["recent"], c][-CONTEXT:]
        errors = []
        for (x, y), (count, seen) in s["links"].items():
            if c in (x, y):
                other = s["value"].get(y if x == c else x, 0.0)
                errors.append((0.7 * math.log(1 + count) + 0.3 * math.exp(-max(0.0, now - seen) / TAU)) * (v - other) ** 2)
        alpha = min(0.7, 0.007 * s["n"])
        weight = alpha * s["count"][c] / s["n"] + (1 - alpha) * r["level_score"]
        out = {by: r[by], **{o: r[o] for o in order}, "concept": c, "n": s["n"], "value": v, "pair_value": s["value"].get(opposite.get(c, ""), 0.0)}
        return s, {**out, "link_error": sum(errors) / len(errors) if errors else 0.0, "weight": weight, "emergence": kind}

    kind = {f.name: f.dataType.simpleString() for f in observations.schema}
    lead = ", ".join(f"`{c}` {kind[c]}" for c in (by, *order))
    return scan_by_key(observations, [by], order, step, f"{lead}, concept string, n long, value double, pair_value double, link_error double, weight double, emergence string", partitions)
