"""Scans of ordered rows for what is sequential by nature, such as a hash chain or a recurrence rounded at each step.

A key's rows lie in one partition, sorted, and stream past a state: memory holds one batch and one state, never a
whole key. Where a result can be joined from stretches, ``operators.skew.fold_by_range`` should be used instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

Step = Callable[[dict | None, dict], tuple[dict, dict | None]]


def scan_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: str, partitions: int | None = None) -> DataFrame:
    """Rows that ``step`` gives for each row in order. ``step(state, row)`` gives (new state, row out or None); a new key begins with state None."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                k = [row[c] for c in keys]
                if k != key:
                    key, state = k, None
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist(out, out_schema)

    n = [partitions] if partitions else []
    return df.repartition(*n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
