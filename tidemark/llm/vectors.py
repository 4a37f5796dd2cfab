"""Sparse vectors of map columns: canonical rows, unit directions and stable projections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_rows(df: DataFrame, id_col: str, map_col: str, order_col: str | None = None) -> DataFrame:
    """One row (id, keys, values) per id with a direction: keys ascending, zeros and nulls dropped, length 1.

    A key is the 64-bit hash of its dimension's name, a quarter of the bytes of a name to shuffle.

    Of several rows of an id the one latest by ``order_col`` holds (ties by the vector itself). Null ids,
    null and empty vectors and vectors of length 0 (or not finite) have no row. Values are rounded to 12
    places so that equal directions meet.
    """
    entries = F.filter(F.map_entries(map_col), lambda e: e["value"].isNotNull() & (e["value"] != 0) & ~F.isnan(e["value"]))
    hashed = F.transform(entries, lambda e: F.struct(F.xxhash64(e["key"]).alias("key"), e["value"].alias("value")))
    v = df.select(F.col(id_col).cast("string").alias("id"), F.sort_array(hashed).alias("e"), (F.col(order_col) if order_col else F.lit(0)).alias("o"))
    v = v.filter(F.col("id").isNotNull() & (F.size("e") > 0))
    v = v.groupBy("id").agg(F.max(F.struct("o", "e"))["e"].alias("e"))
    top = F.array_max(F.transform("e", lambda x: F.abs(x["value"])))
    v = v.withColumn("top", top).filter((F.col("top") > 0) & (F.col("top") < float("inf")))
    # Scaled by the largest value first, so that squares neither overflow nor vanish.
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + (x["value"] / F.col("top")) * (x["value"] / F.col("top"))))
    v = v.withColumn("norm", norm)
    keys = F.transform("e", lambda x: x["key"])
    values = F.transform("e", lambda x: F.rint(x["value"] / F.col("top") / F.col("norm") * 1e12) / 1e12)
    return v.select("id", keys.alias("keys"), values.alias("values"))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of equal direction grouped: (one row rep, keys, values per class; one row id, rep per vector).

    The representative is the smallest id. The fold of a class keeps only its smallest id per task.
    """
    rounded = F.transform("values", lambda x: F.rint(x * 1e9))
    key = F.struct(F.xxhash64("keys", rounded).alias("a"), F.xxhash64(F.lit(1), "keys", rounded).alias("b"))
    keyed = vectors.withColumn("k", key)
    reps = keyed.groupBy("k").agg(F.min("id").alias("rep"))
    member = keyed.select("id", "k").join(reps, "k").select("id", "rep")
    best = keyed.groupBy("k").agg(F.min_by(F.struct("id", "keys", "values"), "id").alias("v"))
    return best.select(F.col("v.id").alias("rep"), "v.keys", "v.values"), member


class Sparse:
    """A batch of sparse rows: ``names`` of its dimensions, ``dim``, ``val`` and row ``offset`` arrays."""

    def __init__(self, keys: pa.ListArray, values: pa.ListArray):
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        enc = keys.flatten().dictionary_encode()
        self.names = enc.dictionary.to_pylist()
        self.dim = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.val = values.flatten().to_numpy(zero_copy_only=False)
        self.offset = np.concatenate([[0], np.cumsum(np.diff(keys.offsets.to_numpy()))])
        self.row = np.repeat(np.arange(len(keys)), np.diff(self.offset))

    def __len__(self) -> int:
        return len(self.offset) - 1

    def dense(self, lo: int, hi: int) -> np.ndarray:
        """Rows lo..hi over the batch's own dimensions."""
        out = np.zeros((hi - lo, len(self.names)), np.float32)
        a, b = self.offset[lo], self.offset[hi]
        out[self.row[a:b] - lo, self.dim[a:b]] = self.val[a:b]
        return out


_drawn: dict[tuple[int, int, int], np.ndarray] = {}


def stable_directions(names: list, width: int, seed: int) -> np.ndarray:
    """Normal (2-stable) coefficients of each dimension, drawn from a hash of its name: the same on every task."""
    if len(_drawn) > 200_000:
        _drawn.clear()
    out = np.empty((len(names), width))
    for i, n in enumerate(names):
        k = (n, width, seed)
        if k not in _drawn:
            h = int.from_bytes(hashlib.blake2b(str(n).encode(), digest_size=8, salt=str(seed).encode()[:8]).digest(), "little")
            _drawn[k] = np.random.default_rng(h).standard_normal(width)
        out[i] = _drawn[k]
    return out


def project(s: Sparse, width: int, seed: int) -> np.ndarray:
    """The rows in ``width`` stable projections: squared distances grow by a chi-square factor."""
    r = stable_directions(s.names, width, seed)
    out = np.zeros((len(s), width))
    for j in range(width):
        out[:, j] = np.bincount(s.row, weights=s.val * r[s.dim, j], minlength=len(s))
    return out


def with_projection(vectors: DataFrame, width: int, seed: int, id_col: str = "rep") -> DataFrame:
    """``vectors`` with ``p``, the projected point of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = project(Sparse(b.column(1), b.column(2)), width, seed)
                flat = pa.array(np.ascontiguousarray(p).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, width, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[id_col, "keys", "values", "p"])

    return vectors.select(id_col, "keys", "values").mapInArrow(run, f"{id_col} string, keys array<bigint>, values array<double>, p array<double>")
