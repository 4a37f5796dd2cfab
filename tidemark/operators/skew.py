"""Per-key results that stay balanced when a handful of keys hold most of the rows.

Rows (or, where order doesn't matter, partial states that each task folded first) are range-partitioned on the
composite (key, order) with Spark's sampled quantiles, so a heavy key is cut across neighbouring partitions instead of
landing in one. Each partition, sorted, folds the run of every key it holds. A key inside a partition is complete; only
the first and the last run of each partition may go on in a neighbour, and only these, at most two per partition, are
stitched in order at the end. No task ever receives all rows of a heavy key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import written

#: Partial states a task holds before it emits them.
STATES_IN_MEMORY = 200_000

#: Folds the runs (starts, ends) of a sorted table to one row of keys and state each.
Fold = Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table]
#: Joins the states of two neighbouring runs of one key, the earlier first.
Merge = Callable[[dict, dict], dict]


def run_bounds(t: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys begin and end."""
    ends = [pc.run_end_encode(t.column(k).combine_chunks()).run_ends.to_numpy() for k in keys]
    ends = np.unique(np.concatenate(ends))
    return np.concatenate([[0], ends[:-1]]), ends


def _folded_runs(keys: Sequence[str], names: Sequence[str], fold: Fold, merge: Merge, edges: bool):
    """Task that folds the runs of its sorted rows; with ``edges`` it adds the place of the first and last run (null inside)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if edges else 0
        held: dict | None = None
        first = True
        schema: pa.Schema | None = None

        def out(rows: list[dict], place: int | None) -> pa.RecordBatch:
            arrays = [pa.array([r[n] for r in rows], schema.field(n).type) for n in names]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([place] * len(rows), pa.int64())], names=[*names, "place"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            s = fold(t, *run_bounds(t, keys)).select(names)
            schema = s.schema
            head = s.slice(0, 1).to_pylist()[0]
            if held is not None and all(held[k] == head[k] for k in keys):
                head = {**head, **merge(held, head)}
            elif held is not None:
                yield out([held], 2 * part if first and edges else None)
                first = False
            if s.num_rows == 1:
                held = head
                continue
            yield out([head], 2 * part if first and edges else None)
            first = False
            inside = s.slice(1, s.num_rows - 2)
            if inside.num_rows:
                place = pa.nulls(inside.num_rows, pa.int64())
                yield from inside.append_column("place", place).combine_chunks().to_batches()
            held = s.slice(s.num_rows - 1, 1).to_pylist()[0]
        if held is not None:
            yield out([held], 2 * part + 1 if edges else None)

    return run


def fold_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, fold: Fold, merge: Merge, partitions: int | None = None) -> DataFrame:
    """One row per key (null is a key like others) with its state, folded in the order of ``order``.

    ``state`` is the schema of the state's columns; ``fold`` gives keys and state of each run. The result reads a
    table in the shared folder. Ties of ``order`` come in any order, so it should name a row.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], *T._parse_datatype_string(state).fields])
    names = kinds.fieldNames()
    marked = T.StructType([*kinds.fields, T.StructField("place", T.LongType())])
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    runs = written(ranged.mapInArrow(_folded_runs(keys, names, fold, merge, True), marked), "runs")
    edge = runs.filter("place is not null").coalesce(1).sortWithinPartitions("place")
    stitched = edge.mapInArrow(_folded_runs(keys, names, lambda t, s, e: t if len(s) == t.num_rows else _merged(t, s, e, names, merge), merge, False), marked)
    return runs.filter("place is null").unionByName(stitched).select(*names)


def _merged(t: pa.Table, starts: np.ndarray, ends: np.ndarray, names: Sequence[str], merge: Merge) -> pa.Table:
    rows = t.select(names).to_pylist()
    out = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        r = rows[a]
        for x in rows[a + 1 : b]:
            r = {**r, **merge(r, x)}
        out.append(r)
    return pa.Table.from_pylist(out, t.select(names).schema)


def _sums(keys: Sequence[str], sums: Sequence[str]) -> tuple[Callable[[list[pa.Table]], pa.Table], Fold, Merge]:
    how = [("lo", "min"), ("hi", "max"), ("n_rows", "sum"), *((s, "sum") for s in sums)]

    def merge_tables(tables: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(tables).combine_chunks()
        g = t.group_by(list(keys), use_threads=False).aggregate(how)
        return g.rename_columns([c if c in keys else c.rsplit("_", 1)[0] for c in g.column_names]).select(t.column_names)

    def merge(a: dict, b: dict) -> dict:
        some = lambda f, c: f([x for x in (a[c], b[c]) if x is not None], default=None)
        return {"lo": some(min, "lo"), "hi": some(max, "hi"), "n_rows": a["n_rows"] + b["n_rows"], **{s: a[s] + b[s] for s in sums}}

    def fold(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
        # By runs, not by a hash aggregate, which gives its groups in any order.
        def extreme(c: str, none: int, pick: np.ufunc) -> pa.Array:
            a = t.column(c).combine_chunks()
            known = np.add.reduceat(np.asarray(a.is_valid()).astype(np.int64), starts) > 0
            return pa.array(pick.reduceat(a.fill_null(none).to_numpy(), starts), mask=~known)

        big = 2**63 - 1
        state = {"lo": extreme("lo", big, np.minimum), "hi": extreme("hi", -big, np.maximum)}
        state |= {c: pa.array(np.add.reduceat(t.column(c).to_numpy(), starts)) for c in ("n_rows", *sums)}
        return pa.table({**{k: t.column(k).take(pa.array(starts)) for k in keys}, **state})

    return merge_tables, fold, merge


def _partials(merge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = fresh = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(merge([pa.Table.from_batches([b])]))
            n += held[-1].num_rows
            fresh += 1
            if fresh >= 16 or n > STATES_IN_MEMORY:
                held = [merge(held)]
                n, fresh = held[0].num_rows, 0
                if n > STATES_IN_MEMORY:
                    yield from held[0].to_batches()
                    held, n = [], 0
        if held:
            yield from merge(held).to_batches()

    return run


def keyed_rows(df: DataFrame, key_fields: Sequence[str], *cols) -> DataFrame:
    """Each row once per key field: key_field, key_value, ``cols``."""
    keys = [F.struct(F.lit(k).alias("key_field"), F.col(k).cast("string").alias("key_value")) for k in key_fields]
    long = df.select(F.explode(F.array(*keys)).alias("_k"), *cols)
    return long.select("_k.key_field", "_k.key_value", *[c for c in long.columns if c != "_k"])


def balanced_key_totals(
    df: DataFrame, key_fields: Sequence[str], order_col: str, sums: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """Totals per value of each of ``key_fields``: n_rows, lo and hi of ``order_col``, the sum of each of ``sums``.

    Totals don't depend on the order, so each task folds its rows to states before anything moves; the states are what
    is ranged, split and stitched, and the table is read once. Result columns: key_field, key_value, n_rows, lo, hi,
    then ``sums``. A null key is a group of its own (key_value null); null summands count as 0; a null order is ignored
    by lo and hi; an empty input gives no row; repeated rows all count; other columns of the input are never read.
    """
    keys = ["key_field", "key_value"]
    order = F.col(order_col).cast("long")
    summed = [F.coalesce(F.col(s).cast("long"), F.lit(0)).alias(s) for s in sums]
    long = keyed_rows(df, key_fields, order.alias("lo"), order.alias("hi"), F.lit(1).cast("long").alias("n_rows"), *summed)
    long = long.select(*keys, "lo", "hi", "n_rows", *sums)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in long.schema])
    merge_tables, fold, merge = _sums(keys, sums)
    partial = written(long.mapInArrow(_partials(merge_tables), schema), "states")
    state = ", ".join(["lo long", "hi long", "n_rows long", *[f"`{s}` long" for s in sums]])
    got = fold_by_range(partial, keys, ["lo"], state, fold, merge, partitions)
    return got.select(*keys, "n_rows", "lo", "hi", *sums)


def heavy_keys(df: DataFrame, key_fields: Sequence[str], order_col: str, share: float = 0.01) -> DataFrame:
    """Values of each key field that hold at least ``share`` of all rows as stored (null is no key).

    Result: key_field, key_value. An empty input gives no row.
    """
    totals = balanced_key_totals(df, key_fields, order_col)
    whole = totals.groupBy("key_field").agg(F.sum("n_rows").alias("_all"))
    heavy = totals.join(F.broadcast(whole), "key_field")
    return heavy.filter(F.col("key_value").isNotNull() & (F.col("n_rows") >= share * F.col("_all"))).select("key_field", "key_value")


def key_sequences(df: DataFrame, key_fields: Sequence[str], order_col: str, value_col: str, partitions: int | None = None) -> DataFrame:
    """What needs the order of each key's rows: n_rows, first and last order and value, widest gap, times the value changed.

    ``order_col`` and ``value_col`` are whole numbers. Rows without an order are left out; a null value is a value like
    any other (a change from or to null is a change). Ties of the order go by the value, null first. A null key is a
    group of its own; an empty input gives no row.
    """
    keys = ["key_field", "key_value"]
    rows = keyed_rows(df.filter(F.col(order_col).isNotNull()), key_fields, F.col(order_col).cast("long").alias("at"), F.col(value_col).cast("long").alias("value"))

    def fold(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
        at = t.column("at").to_numpy()
        v = t.column("value").combine_chunks()
        known = np.asarray(v.is_valid())
        val = np.asarray(v.fill_null(0))
        gap = np.concatenate([[0], np.diff(at)])
        change = np.concatenate([[0], (np.diff(val) != 0) | (np.diff(known.astype(np.int8)) != 0)]).astype(np.int64)
        gap[starts], change[starts] = 0, 0
        take = lambda rows: v.take(pa.array(rows))
        new = {
            "n_rows": pa.array(ends - starts, pa.int64()),
            "first_at": pa.array(at[starts]),
            "last_at": pa.array(at[ends - 1]),
            "first_value": take(starts),
            "last_value": take(ends - 1),
            "widest_gap": pa.array(np.maximum.reduceat(gap, starts)),
            "changes": pa.array(np.add.reduceat(change, starts)),
        }
        return pa.table({**{k: t.column(k).take(pa.array(starts)) for k in keys}, **new})

    def merge(a: dict, b: dict) -> dict:
        return {
            "n_rows": a["n_rows"] + b["n_rows"],
            "first_at": a["first_at"],
            "first_value": a["first_value"],
            "last_at": b["last_at"],
            "last_value": b["last_value"],
            "widest_gap": max(a["widest_gap"], b["widest_gap"], b["first_at"] - a["last_at"]),
            "changes": a["changes"] + b["changes"] + (a["last_value"] != b["first_value"]),
        }

    state = "n_rows long, first_at long, last_at long, first_value long, last_value long, widest_gap long, changes long"
    return fold_by_range(rows, keys, ["at", "value"], state, fold, merge, partitions)
