"""Functions over molecules: atoms joined by operators in a formula."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operators of several signs, and those of one that count by themselves.
LONG_OPERATORS = ("⇒+", "-|>")
SIGNS = ("×", "▷", "→", "⊕", "◯", "↺", "〈", "〉", "≡", "≃", "¬")
UNKNOWN, NO_OPERATORS = "__unknown__", "ATOM_ONLY"


def operator_type(formula: Column) -> Column:
    """The operators a formula uses, each once, in order, joined by ``|``; the plain arrow counts only without its plus form."""
    every = F.array_distinct(F.regexp_extract_all(F.coalesce(formula, F.lit("")), F.lit(rf"(⇒\+|-\|>|[{''.join(SIGNS)}⇒])"), 1))
    text = F.array_join(F.sort_array(F.filter(every, lambda x: (x != "⇒") | ~F.coalesce(formula, F.lit("")).contains("⇒+"))), "|")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_OPERATORS))


def formula_operators(formula: Column) -> Column:
    """Operators from left to right."""
    signs = "".join((*SIGNS, "⇒", "|"))
    return F.regexp_extract_all(formula, F.lit(rf"(⇒\+|-\|>|[{signs}])"), 1)


def formula_atoms(formula: Column) -> Column:
    """Ids of atoms in a formula, from left to right."""
    return F.regexp_extract_all(formula, F.lit(r"(aa_\d+)"), 1)


def formula_signature(formula: Column, atoms: Column, operators: Column) -> Column:
    """The formula itself; else its sorted atoms with its operators; else a mark for unknown."""
    ops = F.when(F.size(operators) > 0, F.array_join(operators, "|")).otherwise("NONE")
    made = F.when(F.size(atoms) > 0, F.concat(F.array_join(F.sort_array(atoms), "|"), F.lit("::"), ops))
    return F.coalesce(F.nullif(F.trim(formula), F.lit("")), made, F.lit(UNKNOWN))


def unbalanced(formula: Column) -> Column:
    """Whether the hierarchy brackets of a formula don't close: the depth falls below 0 or ends above it."""
    depth = F.aggregate(
        F.regexp_extract_all(formula, F.lit("([〈〉])"), 1),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda a, x: F.struct((a["now"] + F.when(x == "〈", 1).otherwise(-1)).alias("now"), F.least(a["low"], a["now"] + F.when(x == "〈", 1).otherwise(-1)).alias("low")),
    )
    return (depth["now"] != 0) | (depth["low"] < 0)


def undefined_atoms(formula: Column, known: Column) -> Column:
    """Ids a formula names that aren't among the known ones."""
    return F.array_except(formula_atoms(formula), known)


def rigid_strategy(rigidity: Column) -> Column:
    """What a generator should do about an atom: break a crystallised one, settle a volatile one (null: unknown)."""
    return F.when(rigidity > 0.9, "disruptive").when(rigidity < 0.3, "stabilizing").when(rigidity.isNotNull(), "neutral").otherwise("unknown")
