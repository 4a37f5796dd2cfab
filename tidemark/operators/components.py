"""Connected components by propagation of the smallest label over large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


def least_labels(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of the component, for every node of the edges (u, v) but the smallest itself.

    Nodes may be of any type that sorts, also structs. A hub's edges fold to one minimum per task before they are
    shuffled. Rounds grow with the logarithm of the longest path; each is written to the shared folder, so a lost
    executor costs one round. Loops and repeated edges do no harm; without edges there is no row.
    """
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(hung.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now
