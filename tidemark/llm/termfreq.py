"""Frequency of every distinct term by recursive radix spilling.

Rows are spread over tasks by their emission (so a heavy term never lands in one task). Inside a task, terms are
radix-partitioned by hash bits to files, oversized partitions are split again by the next bits, and every partition
is aggregated out-of-core by DuckDB. The partial counts of the tasks, one row per term and task, are then added up.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_dir, task_scratch, written

RADIX_BITS = 4
#: Rows a task holds before it writes them to its pieces, and rows of a piece that is split by further hash bits.
PIECE_ROWS = 1 << 19
OUT = pa.schema([("term", pa.string()), ("emissions", pa.int64()), ("total", pa.int64()), ("records", pa.int64())])
#: One row per emission first (redelivered ones are equal), then one row per term.
SQL = """
with once as (
  select any_value(term) term, any_value(total) total, any_value(records) records from piece where emission is not null group by emission
  union all select term, total, records from piece where emission is null)
select term, count(*)::bigint emissions, coalesce(sum(total), 0)::bigint total, coalesce(sum(records), 0)::bigint records
from once group by term
"""


def _bits(t: pa.Table, depth: int) -> np.ndarray:
    enc = t.column("term").combine_chunks().dictionary_encode()
    words = enc.dictionary.to_pylist()
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words] or [0], dtype=np.uint64)
    part = ((h >> np.uint64(depth * RADIX_BITS)) & np.uint64((1 << RADIX_BITS) - 1)).astype(np.int64)
    codes = enc.indices.fill_null(0).to_numpy(zero_copy_only=False)
    got = part[codes] if len(words) else np.zeros(len(codes), np.int64)
    return np.where(pc.is_null(t.column("term")).to_numpy(zero_copy_only=False), 0, got)


def _split(t: pa.Table, depth: int, folder: str, files: dict) -> None:
    """Append the rows of ``t`` to one spill file per value of the next hash bits."""
    part = _bits(t, depth)
    for p in np.unique(part):
        piece = t.take(pa.array(np.flatnonzero(part == p)))
        if p not in files:
            path = os.path.join(folder, f"{uuid.uuid4().hex}-{depth}-{p}.parquet")
            files[p] = [pq.ParquetWriter(path, t.schema, compression="lz4"), path, 0]
        files[p][0].write_table(piece)
        files[p][2] += piece.num_rows


def _aggregate(piece: str, folder: str) -> pa.Table:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": folder})
    try:
        con.execute(f"create view piece as select * from read_parquet('{piece}')")
        return con.sql(SQL).to_arrow_table().cast(OUT)
    finally:
        con.close()


def _one_term(piece: str) -> bool:
    terms: set = set()
    for b in pq.ParquetFile(piece).iter_batches(columns=["term"]):
        terms.update(pc.unique(b.column(0)).to_pylist())
        if len(terms) > 1:
            return False
    return True


def _spilled(files: dict, depth: int, folder: str, piece_rows: int) -> Iterator[pa.RecordBatch]:
    for writer, _, _ in files.values():
        writer.close()
    for _, path, rows in files.values():
        if rows > piece_rows and (depth + 1) * RADIX_BITS < 64:
            deeper: dict = {}
            for b in pq.ParquetFile(path).iter_batches(batch_size=piece_rows):
                _split(pa.Table.from_batches([b]), depth + 1, folder, deeper)
            os.unlink(path)
            if len(deeper) == 1:
                # These bits split nothing: a single term is left to DuckDB, which aggregates out of core; others go on.
                (writer, only, _), = deeper.values()
                writer.close()
                if _one_term(only):
                    yield from _aggregate(only, folder).to_batches()
                    continue
            yield from _spilled(deeper, depth + 1, folder, piece_rows)
        else:
            yield from _aggregate(path, folder).to_batches()


def _task(shared: str, piece_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, files, folder = 0, {}, task_scratch(shared)
        try:
            for b in batches:
                held.append(b)
                n += b.num_rows
                if n > piece_rows:
                    _split(pa.Table.from_batches(held), 0, folder, files)
                    held, n = [], 0
            if held:
                _split(pa.Table.from_batches(held), 0, folder, files)
            yield from _spilled(files, 0, folder, piece_rows)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def term_frequency(
    df: DataFrame, term: str, emission: str, total: str, records: str, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """One row per distinct term: term, emissions, total, records.

    Every emission counts once, however often it was delivered; rows without an emission id count each by
    itself. Null amounts count as 0. The null term is a row of its own (term null); the empty string is a
    term. An empty table gives no row; other columns are never read.
    """
    rows = df.select(
        F.col(term).cast("string").alias("term"),
        F.col(emission).cast("long").alias("emission"),
        F.col(total).cast("long").alias("total"),
        F.col(records).cast("long").alias("records"),
    )
    lone = F.xxhash64("term", "total", "records", F.monotonically_increasing_id())
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.repartition(n, F.coalesce("emission", lone))
    partial = parts.mapInArrow(_task(shared_dir(df.sparkSession), piece_rows), "term string, emissions long, total long, records long")
    return partial.groupBy("term").agg(
        F.sum("emissions").alias("emissions"), F.sum("total").alias("total"), F.sum("records").alias("records")
    )


def marked(freq: DataFrame, common_share: float = 0.002, rare_records: int = 2) -> DataFrame:
    """``freq`` with ``mark``: common, rare, or null for a term of use. The null term gets no mark.

    The share is of all emissions, those with a null term included. ``freq`` is kept as a written table,
    because the total needs it whole before the first row can be marked.
    """
    kept = written(freq, "terms")
    total = kept.agg(F.coalesce(F.sum("emissions"), F.lit(0))).first()[0]
    mark = F.when(F.col("emissions") >= common_share * total, "common").when(F.col("records") <= rare_records, "rare")
    return kept.withColumn("mark", F.when(F.col("term").isNotNull(), mark))
