"""Memory, index and queue as streams: each equals its batch form over the same log."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scores import ALPHA
from tidemark.session import shared_dir

STATE = "tau double, weight double, n long, created long, updated long"
OUT = "fingerprint string, tau double, weight double, observation_count long, created_us long, updated_us long"


def memory_stream(observations: DataFrame) -> DataFrame:
    """Memory entries as they change, by key: decay, then reinforcement, in the order of time and event inside a batch.

    ``observations``: a stream of fingerprint, us (microseconds), event_id, tau. State per key is one row.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tau, w, n, created, updated = state.get if state.exists else (0.0, 0.0, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        for us, t in zip(rows["us"].tolist(), rows["tau"].tolist()):
            if n == 0:
                tau, w, created = float(t), 1.0, us
            else:
                w *= math.exp(-max(0.0, (us - updated) / 1e6) / tau)
                w += ALPHA * (1 - w)
            n, updated = n + 1, us
        state.update((tau, w, n, created, updated))
        yield pd.DataFrame([(key[0], tau, w, n, created, updated)], columns=[c.split()[0] for c in OUT.split(", ")])

    return observations.groupBy("fingerprint").applyInPandasWithState(step, OUT, STATE, "update", "NoTimeout")


def formula_counts_stream(events: DataFrame) -> DataFrame:
    """Counts of (atom, formula_signature) with first and last seq, updated as events arrive."""
    a = events.select("seq", F.explode("atoms").alias("atom"), "formula_signature").filter(F.col("atom").isNotNull())
    return a.groupBy("atom", "formula_signature").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seen"), F.max("seq").alias("last"))


def first_per_key_stream(queue: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key wasn't seen within ``delay``: repeats are dropped with bounded state."""
    return queue.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def event_windows(events: DataFrame, time: str, width: str, *by: str, delay: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and key, with late rows up to ``delay`` (an addition of this engine)."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))


def drained(stream: DataFrame, mode: str, key: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote; with ``key`` the last row of each key by ``order``.

    Output and progress lie in the shared folder, so a lost executor repeats a batch, not the stream. Every batch is
    written under its own number: a repeated one replaces itself.
    """
    spark: SparkSession = stream.sparkSession
    base = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/part={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if not q.lastProgress:
        return spark.createDataFrame([], stream.schema)
    d = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, _batch long").parquet(f"{base}/out")
    if not key:
        return d.drop("_batch", "part")
    others = [c for c in stream.columns if c not in key]
    return d.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct("_batch", *([order] if order else []))).alias("v")).select(*key, "v.*")
