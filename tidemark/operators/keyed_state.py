"""State kept per key over ordered observations, where each step rounds what the next one starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import scan_by_key

HISTORY = 10


def aggregate_states(observations: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """key, n, first, last, volatility_last, volatility_max, average, history: the state after each key's last observation.

    ``observations``: key, order, volatility, seconds. The running average is rounded to three places at each step, as
    it is stored between runs, so it isn't the mean; the history holds the last ten values. Rows stream past the
    state in order: memory doesn't grow with a key's observations. A null volatility counts 0.
    """

    def step(state: dict | None, r: dict) -> tuple[dict, dict]:
        v = r["volatility"] or 0.0
        if state is None:
            s = {"n": 1, "first": r["seconds"], "most": max(0.0, v), "average": round(v, 3), "history": [v]}
        else:
            n = state["n"] + 1
            s = {"n": n, "first": state["first"], "most": max(state["most"], v), "average": round((state["average"] * (n - 1) + v) / n, 3), "history": [*state["history"], v][-HISTORY:]}
        return s, {key: r[key], "n": s["n"], "first": s["first"], "last": r["seconds"], "volatility_last": v, "volatility_max": s["most"], "average": s["average"], "history": s["history"]}

    kind = observations.schema[key].dataType.simpleString()
    steps = scan_by_key(observations, [key], order, step, f"`{key}` {kind}, n long, first double, last double, volatility_last double, volatility_max double, average double, history array<double>", partitions)
    others = [c for c in steps.columns if c != key]
    return steps.groupBy(key).agg(F.max_by(F.struct(*others), "n").alias("v")).select(key, "v.*")


def pending(states: DataFrame, key: str, k: int = 100) -> DataFrame:
    """Keys that need more observation first (an unsettled history), then those observed least."""
    tail = F.slice("history", -3, 3)
    settled = F.coalesce(F.when(F.size("history") >= 3, F.array_max(tail) - F.array_min(tail) < 0.1), F.lit(False))
    return states.withColumn("needs", ~settled).orderBy(F.desc("needs"), "n", key).limit(k)
