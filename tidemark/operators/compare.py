"""Comparison of two states of a table: what is missing on a side and what differs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """keys, difference (missing_left, missing_right or changed), fields: every key that isn't the same on both sides.

    Keys must be unique on each side and not null. Numbers of type double may differ by ``tolerance``, a null one
    counting as 0 then; other values are equal if both are null.
    """
    a = left.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("in_a"))
    b = right.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("in_b"))
    j = a.join(b, list(keys), "full_outer")

    def unlike(v: str):
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        if tolerance and left.schema[v].dataType.simpleString() in ("double", "float"):
            return F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))) > tolerance
        return ~x.eqNullSafe(y)

    changed = F.filter(F.array(*[F.when(unlike(v), F.lit(v)) for v in values]), lambda x: x.isNotNull())
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    kind = F.when(F.col("in_a").isNull(), "missing_left").when(F.col("in_b").isNull(), "missing_right").when(F.size(changed) > 0, "changed")
    d = j.select(*keys, kind.alias("difference"), F.when(both, F.array_join(changed, ",")).alias("fields"))
    return d.filter(F.col("difference").isNotNull())
