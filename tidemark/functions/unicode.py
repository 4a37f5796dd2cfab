"""The general Unicode path, where the JVM has no function: Arrow batches, never one row at a time."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def _nfkc(v: pa.Array) -> pa.Array:
    # Arrow's own kernel leaves the compatibility form decomposed, so each distinct text is composed once here.
    d = pc.dictionary_encode(v)
    forms = [x if x.isascii() else unicodedata.normalize("NFKC", x) for x in d.dictionary.to_pylist()]
    return pa.array(forms, pa.string()).take(d.indices)


def normalized_any(token: Column) -> Column:
    """Compatibility form, lower case, no punctuation or space at the ends; null where nothing is left. Null stays null."""
    edge = r"[^\p{L}\p{N}_\s]+"
    cut = F.regexp_replace(F.regexp_replace(F.lower(_nfkc(token)), f"^{edge}", ""), f"{edge}$", "")
    return F.nullif(F.regexp_replace(cut, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))
