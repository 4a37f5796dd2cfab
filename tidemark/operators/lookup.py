"""Lookups against dictionaries: triggers, edges with stand-ins, caches with an end date, molecules against a glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.molecules import undefined_atoms, unbalanced
from tidemark.functions.text import trigger_words

# How much an edge keeps that comes from a neighbour of each kind.
DECAY = {"similar": 0.8, "also_see": 0.8, "hypernym": 0.5, "instance_hypernym": 0.6, "derivational": 0.6, "member_holonym": 0.4, "part_holonym": 0.4}
NEIGHBOURS = 10
TTL_SECONDS = 7 * 86400


def trigger_index(glossary: DataFrame, concept: str, triggers: str) -> DataFrame:
    """word, concept: each trigger, trimmed and in lower case, with the concepts it stands for, once each."""
    t = glossary.select(concept, F.explode(triggers).alias("_t")).select(F.trim(F.lower("_t")).alias("word"), concept)
    return t.filter(F.col("word") != "").distinct()


def triggered(texts: DataFrame, ident: str, text: str, index: DataFrame, concept: str, k: int | None = None) -> DataFrame:
    """ident, concept, score (half a point per occurrence), words: concepts whose triggers stand in a text; with ``k`` ranked.

    Words of a text are counted inside its row first, so a frequent word meets the index once per text.
    """
    w = texts.select(ident, F.explode(trigger_words(F.col(text))).alias("word")).groupBy(ident, "word").agg(F.count(F.lit(1)).alias("n"))
    m = w.join(index, "word").groupBy(ident, concept).agg((F.sum("n") * 0.5).alias("score"), F.count(F.lit(1)).alias("words"))
    if k is None:
        return m
    r = F.row_number().over(Window.partitionBy(ident).orderBy(F.desc("score"), concept))
    return m.withColumn("rank", r).filter(F.col("rank") <= k)


def with_stand_ins(idents: DataFrame, edges: DataFrame, relations: DataFrame, ident: str) -> DataFrame:
    """Edges of each ident, or, where it has none, those of its best neighbour: ident, source, decay and the edge's columns.

    ``relations``: ident, neighbour, relation, position (of the neighbour in its list; the first ten count). The best
    neighbour has the largest raw score, then the largest decay, then the smallest id.
    """
    own = idents.join(edges, ident).withColumns({"source": F.col(ident), "decay": F.lit(1.0)})
    without = idents.join(edges.select(ident).distinct(), ident, "left_anti")
    decay = F.coalesce(*[F.when(F.col("relation") == r, F.lit(d)) for r, d in DECAY.items()])
    near = without.join(relations.filter(F.col("position") < NEIGHBOURS), ident).withColumn("decay", decay).filter("decay is not null")
    top = edges.groupBy(F.col(ident).alias("neighbour")).agg(F.max("raw_score").alias("_top"))
    best = near.join(top, "neighbour").groupBy(ident).agg(F.min_by(F.struct("neighbour", "decay"), F.struct(-F.col("_top"), -F.col("decay"), "neighbour")).alias("b"))
    others = edges.withColumnRenamed(ident, "source")
    lent = best.select(ident, F.col("b.neighbour").alias("source"), F.col("b.decay").alias("decay")).join(others, "source")
    return own.select(*lent.columns).unionByName(lent)


def live(cache: DataFrame, now: Column, stored: str = "stored_at", ttl: int = TTL_SECONDS) -> DataFrame:
    """Entries of a cache that haven't expired."""
    return cache.filter(F.unix_micros(stored) + ttl * 10**6 > F.unix_micros(now))


def refreshed(cache: DataFrame, new: DataFrame, key: str, stored: str = "stored_at") -> DataFrame:
    """The cache with new entries in place of older ones of the same key."""
    both = cache.unionByName(new)
    others = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*others), stored).alias("v")).select(key, "v.*")


def molecule_errors(molecules: DataFrame, levels: DataFrame, ident: str) -> DataFrame:
    """ident, error, what: atoms and levels a glossary lacks, ids a formula doesn't define, brackets that don't close.

    ``molecules``: ident, formula, active array of (atom, axis, level); ``levels``: atom, axis, level of the glossary.
    """
    a = molecules.select(ident, F.explode("active").alias("a")).select(ident, "a.*")
    known = levels.select("atom").distinct()
    atoms = a.select(ident, "atom").distinct().join(known, "atom", "left_anti").select(ident, F.lit("unknown_atom").alias("error"), F.col("atom").alias("what"))
    placed = a.filter("axis is not null").join(known, "atom", "left_semi").join(levels, ["atom", "axis", "level"], "left_anti")
    places = placed.select(ident, F.lit("unknown_level").alias("error"), F.concat_ws("/", "atom", "axis", "level").alias("what")).distinct()
    ids = molecules.select(ident, F.explode(undefined_atoms(F.coalesce("formula", F.lit("")), F.col("active.atom"))).alias("what")).select(ident, F.lit("undefined_id").alias("error"), "what")
    open_ = molecules.filter(unbalanced(F.coalesce("formula", F.lit("")))).select(ident, F.lit("brackets").alias("error"), F.col("formula").alias("what"))
    return atoms.unionByName(places).unionByName(ids).unionByName(open_)


def coerced(active: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows of (atom, axis, level) with what the glossary lacks set to null: an unknown axis takes its level along."""
    axes = levels.select("atom", "axis").distinct().withColumn("_a", F.lit(True))
    j = active.join(axes, ["atom", "axis"], "left").join(levels.withColumn("_l", F.lit(True)), ["atom", "axis", "level"], "left")
    kept = [c for c in active.columns if c not in ("atom", "axis", "level")]
    return j.select(*kept, "atom", F.when(F.col("_a"), F.col("axis")).alias("axis"), F.when(F.col("_l"), F.col("level")).alias("level"), (F.col("_a").isNull() | F.col("_l").isNull()).alias("changed"))
