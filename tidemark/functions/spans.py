"""Spans of pieces of a text: cut by patterns in the JVM, placed by running sums over whole Arrow batches.

Only lengths cross to Python; texts stay in the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Every space character, also those Java's plain ``\s`` leaves out.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
# Words before a full stop that end no sentence.
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr vs etc inc ltd co corp jan feb mar apr jun jul aug sep oct nov dec st ave blvd rd cf al"
).split()
#: The place after a sentence's last sign: a capital or the end follows, no abbreviation and no initials precede.
SENTENCE_END = (
    rf"(?<=[.!?])(?=(?:{SPACE}+[A-Z]|{SPACE}*\z))"
    rf"(?<!(?<!\p{{L}})(?i:{'|'.join(ABBREVIATIONS)})[.!?])"
    r"(?<!\.\p{L}?(?s:.)[.!?])"
)
PARAGRAPH_BREAK = rf"\n{SPACE}*\n"


@F.arrow_udf(ArrayType(IntegerType()))
def _running(v: pa.Array) -> pa.Array:
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(v.offsets.to_numpy())
    if v.null_count:
        sizes = np.where(np.asarray(v.is_null()), 0, sizes)
    ends = np.concatenate([[0], np.cumsum(flat)])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    starts = ends[:-1] - np.repeat(ends[offsets[:-1]], sizes)
    out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(starts.astype(np.int32)))
    return out


def running(lengths: Column) -> Column:
    """Sum of the numbers before each element of an array (null gives an empty array)."""
    return _running(lengths)


def sentence_pieces(text: Column) -> Column:
    """The text cut after each sentence; joined, the pieces are the text."""
    return F.split(text, SENTENCE_END)


def edges(piece: Column) -> Column:
    """Struct (size, lead, core): length, leading space, length without space at both ends."""
    left = F.regexp_replace(piece, f"^{SPACE}+", "")
    return F.struct(
        F.length(piece).alias("size"), (F.length(piece) - F.length(left)).alias("lead"), F.length(F.regexp_replace(left, f"{SPACE}+\\z", "")).alias("core")
    )


def placed(cut: Column, starts: Column, least: int) -> Column:
    """Spans (start, end) of the pieces with at least ``least`` characters besides space at the ends.

    ``cut``: array of ``edges`` structs; ``starts``: where each piece begins. Both should be plain columns.
    """
    spans = F.transform(cut, lambda e, i: F.struct((F.get(starts, i) + e["lead"]).alias("start"), (F.get(starts, i) + e["lead"] + e["core"]).alias("end")))
    return F.filter(spans, lambda s: s["end"] - s["start"] >= max(1, least))
