"""String searches that the JVM has no linear function for: Arrow batches, one pass per text."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType


@F.arrow_udf(ArrayType(IntegerType()))
def _occurrences(text: pa.Array, part: pa.Array) -> pa.Array:
    out = []
    for t, p in zip(text.to_pylist(), part.to_pylist()):
        found: list[int] = []
        if t and p:
            low, ref = t.lower(), p.lower()
            at = low.find(ref)
            while at >= 0:
                found.append(at)
                at = low.find(ref, at + 1)
        out.append(found)
    return pa.array(out, pa.list_(pa.int32()))


def occurrences(text: Column, part: Column) -> Column:
    """Where a text holds another, case aside, overlapping ones included; none for null or empty."""
    return _occurrences(text, part)


def nearest_occurrence(places: Column, position: Column) -> Column:
    """The occurrence closest to a position, the earlier on a tie; null without any."""
    return F.array_min(F.transform(places, lambda p: F.struct(F.abs(p - position).alias("d"), p.alias("p"))))["p"]


@F.arrow_udf(StringType())
def _inner_object(text: pa.Array) -> pa.Array:
    return pa.array([_first_object(t) for t in text.to_pylist()], pa.string())


def _first_object(text: str | None) -> str | None:
    if not text:
        return None
    text = text.rsplit("</think>", 1)[-1]
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = json.JSONDecoder().raw_decode(text[at:])
            return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            at = text.find("{", at + 1)
    return None


def inner_object(text: Column) -> Column:
    """The first whole JSON object of a free text (after its thoughts, inside fences or not), canonical; null without any."""
    return _inner_object(text)
