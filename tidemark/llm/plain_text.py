"""Stored terms that aren't in plain form, with their plain form."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.codepoints import plain_column


def plain_forms(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """One row (``id_col``, field, plain) per row and field whose stored text differs from its plain form.

    Plain: composed accents, letters of the word's own script in usual width and style, ordinary spaces and
    none at the ends, nothing invisible; upper and lower case stay. Null fields are never listed; a text of
    invisible characters has the empty plain form; repeated rows are each listed; an empty table gives no row.
    Narrow: no shuffle; rows of printable ASCII without spaces at the ends never leave the JVM.
    """
    kind = df.schema[id_col].dataType.simpleString()
    # Look-alikes, marks, widths and invisible characters all lie outside printable ASCII.
    suspect = [F.col(f).rlike(r"[^\x20-\x7e]|^ | $") for f in fields]
    some = suspect[0]
    for s in suspect[1:]:
        some = some | F.coalesce(s, F.lit(False))
    rows = df.filter(F.coalesce(some, F.lit(False)) if len(fields) == 1 else some).select(id_col, *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, f in enumerate(fields, 1):
                col = b.column(i)
                enc = pc.dictionary_encode(col)
                plain = plain_column(enc.dictionary.cast(pa.string()))
                differs = pc.fill_null(pc.not_equal(plain, enc.dictionary.cast(pa.string())), False).to_numpy(zero_copy_only=False)
                codes = enc.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero((codes >= 0) & differs[codes]) if len(differs) else np.zeros(0, np.int64)
                if len(hit):
                    at = pa.array(hit)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(at), pa.array([f] * len(hit)), plain.take(pa.array(codes[hit]))], names=[id_col, "field", "plain"]
                    )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, field string, plain string")


def plain_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row's id with its running text in plain form (look-alikes folded word by word, spaces kept); null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), plain_column(b.column(1), words=False)], names=[id_col, text_col])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{text_col}` string")
