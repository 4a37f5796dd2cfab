"""Words against a fixed list of reference words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import TYPO_DISTANCE, TYPO_LEAST, TYPO_WORDS, typo_confidence


def typo_candidates(words: DataFrame, col: str, reference: Sequence[str] = TYPO_WORDS, most: int = 3) -> DataFrame:
    """Words that lie within two edits of a reference word: suggestion, distance, confidence and the best candidates.

    The suggestion is the nearest word (ties by the word) where its confidence is at least 0.7, else null; candidates
    are given for words of three to six characters, by confidence, then by word. The reference words are a constant
    array inside the row, so nothing is joined. Null and shorter words have no row.
    """
    w = F.col(col)
    near = F.transform(
        F.array(*[F.lit(r) for r in sorted(reference)]),
        lambda r: F.struct(F.levenshtein(w, r, TYPO_DISTANCE).alias("d"), r.alias("r"), F.length(r).alias("n")),
    )
    hit = F.filter(near, lambda x: x["d"] > 0)
    found = words.filter(F.length(w) >= 3).select(col, hit.alias("hit")).filter(F.size("hit") > 0)
    conf = lambda x: F.round(typo_confidence(x["d"], F.length(w), x["n"]), 9)
    best = F.array_min("hit")
    ranked = F.sort_array(F.transform("hit", lambda x: F.struct((-conf(x)).alias("c"), x["r"].alias("r"))))
    found = found.select(col, best.alias("b"), ranked.alias("ranked"))
    sure = typo_confidence(F.col("b.d"), F.length(w), F.col("b.n"))
    names = F.array_join(F.transform(F.slice("ranked", 1, most), lambda x: x["r"]), "|")
    return found.select(
        col,
        F.when(sure >= TYPO_LEAST, F.col("b.r")).alias("suggestion"),
        F.col("b.d").cast("long").alias("distance"),
        F.round(sure, 3).alias("confidence"),
        F.when(F.length(w) <= 6, names).otherwise("").alias("candidates"),
    )
