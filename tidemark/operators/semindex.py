"""The semantic index over observed molecules: atoms and their formulas, directions, pairs of atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.molecules import rigid_strategy
from tidemark.functions.scores import rigidity_class

WINDOW, HISTORY = 1000, 10_000


def atom_stats(events: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per atom: count_total, frequency (at most ``window``), rigidity and its class, mode_formula, strategy, alert.

    ``events``: seq, atoms, formula_signature. Atoms count as often as an event names them. Rigidity is the share of
    the most frequent formula; of equally frequent ones the first seen is the mode. An alert needs a rigidity of 0.98
    and ten observations.
    """
    a = events.select("seq", F.explode("atoms").alias("atom"), "formula_signature").filter(F.col("atom").isNotNull())
    f = a.groupBy("atom", "formula_signature").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seen"), F.max("seq").alias("last"))
    mode = F.min_by("formula_signature", F.struct(-F.col("n"), F.col("seen"))).alias("mode_formula")
    g = f.groupBy("atom").agg(F.sum("n").alias("count_total"), (F.max("n") / F.sum("n")).alias("rigidity"), mode, F.count(F.lit(1)).alias("formulas"), F.max("last").alias("last_seq"))
    r = F.col("rigidity")
    return g.withColumns(
        {
            "frequency": F.when(F.col("count_total") <= window, F.col("count_total")).otherwise(F.lit(window).cast("long")),
            "class": rigidity_class(r),
            "strategy": rigid_strategy(r),
            "alert": (r >= 0.98) & (F.col("count_total") >= 10),
        }
    )


def cooccurrence(events: DataFrame) -> DataFrame:
    """Pairs of different atoms a < b and in how many events both stand. Pairs are made inside each event's row."""
    s = events.select(F.sort_array(F.array_distinct(F.filter("atoms", lambda x: x.isNotNull()))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return s.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def top_pairs(pairs: DataFrame, atom: str, k: int = 10) -> DataFrame:
    other = F.when(F.col("a") == atom, F.col("b")).otherwise(F.col("a"))
    return pairs.filter((F.col("a") == atom) | (F.col("b") == atom)).select(other.alias("other"), "n").orderBy(F.desc("n"), "other").limit(k)


def direction_balance(events: DataFrame, limit: int = WINDOW) -> DataFrame:
    """One row: total, creative, destructive, neutral (each at most ``limit``) and the shares of the first two."""
    n = lambda d: F.least(F.count(F.when(F.col("direction") == d, 1)), F.lit(limit).cast("long"))
    g = events.agg(n("=>+").alias("creative"), n("-|>").alias("destructive"), n("=>").alias("neutral"))
    total = F.col("creative") + F.col("destructive") + F.col("neutral")
    share = lambda c: F.when(total > 0, F.col(c) / total).otherwise(0.0)
    return g.select(total.alias("total"), "creative", "destructive", "neutral", share("creative").alias("r_creative"), share("destructive").alias("r_destructive"))


class IndexView:
    """The queries of an index over one table of observed events (type ``molecule.observe`` with at least one atom)."""

    def __init__(self, events: DataFrame):
        self.events = events.filter((F.col("event_type") == "molecule.observe") & (F.size("atoms") > 0)) if "event_type" in events.columns else events
        self.atoms = atom_stats(self.events)
        self.pairs = cooccurrence(self.events)

    def atom(self, atom: str) -> DataFrame:
        return self.atoms.filter(F.col("atom") == atom)

    def rigid(self, k: int = 5) -> DataFrame:
        return self.atoms.filter("count_total >= 2").orderBy(F.desc("rigidity"), "atom").limit(k)

    def volatile(self, k: int = 5) -> DataFrame:
        return self.atoms.filter("count_total >= 2").orderBy("rigidity", "atom").limit(k)

    def related(self, atom: str, k: int = 10) -> DataFrame:
        return top_pairs(self.pairs, atom, k)

    def directions(self, limit: int = WINDOW) -> DataFrame:
        return direction_balance(self.events, limit)
