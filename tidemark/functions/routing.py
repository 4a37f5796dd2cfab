"""Weights of several readings of one word: route scores, and what their spread says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scores import clamped, entropy_nats, margin
from tidemark.functions.text import STOPWORDS

# Gates of the decision and of conflict.
MARGIN, ENTROPY, COMPETING = 0.2, 0.9, 0.15


def context_flags(text: Column) -> Column:
    """Struct (capitalized, quoted): most words begin with a capital; the text has quotation marks."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    caps = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return F.struct((F.size(words) > 0).__and__(caps / F.greatest(F.size(words), F.lit(1)) > 0.5).alias("capitalized"), text.rlike("[\"'「」]").alias("quoted"))


def route_scores(typo: Column, title_like: Column, proper: Column, capitalized: Column, quoted: Column, known: Column, linked: Column, word: Column) -> Column:
    """Array of the scores of four readings: a slip, a name or title, a new word, noise."""
    a = F.when(typo.isNull(), F.lit(0.0)).otherwise(clamped(typo - F.when(title_like, 0.15).otherwise(0.0)))
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    b = clamped(0.3 + add(known & proper, 0.25) + add(title_like, 0.2) + add(capitalized, 0.2) + add(quoted, 0.2))
    c = F.when(~known, 0.6).when(~linked, 0.35).otherwise(0.15)
    d = F.when(F.lower(word).isin(STOPWORDS) | (F.length(word) < 2), 0.9).otherwise(0.05)
    return F.array(*[F.round(x, 3) for x in (a, b, c, d)])


def decision(scores: Column) -> Column:
    """Struct (winner, margin, entropy): A to D by the largest score, the first on a tie; null where the spread is too even."""
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    probs = F.transform(scores, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))
    m, e = margin(probs), entropy_nats(probs)
    first = F.array_position(scores, F.array_max(scores)).cast("int")
    winner = F.element_at(F.array(*map(F.lit, "ABCD")), first)
    none = (total <= 0) | (m < MARGIN) | (e > ENTROPY)
    return F.struct(F.when(~none, winner).alias("winner"), F.when(total > 0, m).otherwise(0.0).alias("margin"), F.when(total > 0, e).otherwise(0.0).alias("entropy"))


def uneven(weights: Column, least_margin: float = 0.25, most_entropy: float = 0.85) -> Column:
    """Struct (margin, entropy, high): whether weights lie so close that none stands out."""
    m, e = margin(weights), entropy_nats(weights)
    return F.struct(m.alias("margin"), e.alias("entropy"), ((m < least_margin) | (e > most_entropy)).alias("high"))


def competing(scores: Column) -> Column:
    return F.size(F.filter(scores, lambda x: x >= COMPETING))


def sense_conflict(scores: Column) -> Column:
    """How close the leading readings are, in bands; more with three or more competing."""
    s = F.sort_array(scores, False)
    n = competing(scores)
    gap = F.get(s, F.lit(0)) - F.get(s, F.lit(1))
    band = F.when(gap < 0.10, 0.9).when(gap < 0.15, 0.7).when(gap < 0.25, 0.5).when(gap < 0.35, 0.3).otherwise(0.1)
    return F.when(F.size(scores) < 2, 0.0).when(n < 2, 0.1).otherwise(F.least(F.lit(1.0), band + F.when(n >= 3, 0.2).otherwise(0.0)))


def source_conflict(first: Column, second: Column, contradictions: list[tuple[str, str]]) -> Column:
    """Conflict of two sets of signals: contradicting pairs weigh 0.3 each, the share not held in common 0.4."""
    pairs = F.lit(0.0)
    for a, b in contradictions:
        across = (F.array_contains(first, a) & F.array_contains(second, b)) | (F.array_contains(first, b) & F.array_contains(second, a))
        pairs = pairs + F.when(across, 0.3).otherwise(0.0)
    every = F.array_union(first, second)
    apart = F.size(F.array_except(every, F.array_intersect(first, second))) / F.greatest(F.size(every), F.lit(1))
    return F.when((F.size(first) == 0) | (F.size(second) == 0), 0.1).otherwise(F.least(F.lit(1.0), pairs + 0.4 * apart))


def dispersion(types: Column) -> Column:
    """How scattered claims are, by the number of their types (null: no evidence)."""
    n = F.size(types)
    return F.when(types.isNull(), 0.5).when(n >= 6, 0.7).when(n >= 4, 0.5).when(n >= 2, 0.3).otherwise(0.1)


def volatility(sense: Column, source: Column, spread: Column) -> Column:
    return F.round(clamped(0.5 * sense + 0.3 * source + 0.2 * spread), 3)


def band(value: Column, count: Column) -> Column:
    """quarantine, defer or candidate by volatility and the number of competing readings."""
    return F.when(value >= 0.5, "quarantine").when((value >= 0.25) | (count >= 2), "defer").otherwise("candidate")
