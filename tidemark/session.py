"""Session-level helpers shared by operators: durable scratch space and bounded broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is absent a folder of our own is set once, on one machine only: a cluster must name a folder
    that all of its machines see.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int, *cols: str) -> list | None:
    """Rows of ``df`` if there are at most ``limit``, else None. The check costs one pass over the small side."""
    rows = df.select(*cols).limit(limit + 1).collect() if cols else df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def maybe_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only where the counted ``rows`` keep under ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def task_scratch(shared: str) -> str:
    """Folder for one task's spill files inside the shared folder (only ``file:`` paths can hold local files)."""
    root = shared[len("file://") :] if shared.startswith("file://") else shared if shared.startswith("/") else None
    if root is None:
        root = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]
    path = os.path.join(root, "tidemark", f"task-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the files leave most of them idle, as one unsplittable file does; else ``df`` itself.

    For work that is heavy per row, such as on whole texts. Columns not needed should be dropped first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 4 <= cores else df
