"""Numeric functions as column builders: specificity, entropy, memory weights, bands and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formulas.
EPSILON = 1e-12
ALPHA, FORGET = 0.2, 0.01
TAU = {"permanence": 86400, "continuation": 3600, "establishment": 3600, "transformation": 1800, "indication": 300, "emergence": 60}
DEFAULT_TAU = 300


def specificity(count: Column, total: Column, count_all: Column, total_all: Column) -> Column:
    """Share of a token under a condition times the log of its ratio to the share overall."""
    p, g = count / total, count_all / total_all
    return p * F.log((p + F.lit(EPSILON)) / (g + F.lit(EPSILON)))


def entropy_bits(total: Column, c_log_c: Column, forms: Column) -> Column:
    """Shannon entropy in bits from the sums of counts and of count * log2(count); 0 below two counts or two forms."""
    return F.when((total < 2) | (forms < 2), F.lit(0.0)).otherwise(F.log2(total.cast("double")) - c_log_c / total)


def entropy_nats(weights: Column) -> Column:
    """Natural-log entropy of an array of weights, made to add up to 1; 0 for none or a sum of 0."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    term = lambda a, x: a - F.when(x > 0, (x / total) * F.log(x / total)).otherwise(0.0)
    return F.when(F.coalesce(total, F.lit(0.0)) <= 0, F.lit(0.0)).otherwise(F.aggregate(weights, F.lit(0.0), term))


def margin(weights: Column) -> Column:
    """Difference of the two largest weights; the only one, or 0 for none."""
    w = F.sort_array(weights, False)
    return F.when(F.size(w) == 0, F.lit(0.0)).when(F.size(w) == 1, w[0]).otherwise(w[0] - w[1])


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def decayed(weight: Column, seconds: Column, tau: Column) -> Column:
    """Weight after some time; a time before 0 counts as 0, a tau of 0 or less as the usual one."""
    t = F.when(tau <= 0, F.lit(float(DEFAULT_TAU))).otherwise(tau)
    return clamped(weight * F.exp(-F.greatest(seconds, F.lit(0.0)) / t))


def reinforced(weight: Column, alpha: float = ALPHA) -> Column:
    return clamped(weight + alpha * (1 - weight))


def tau_of(levels: Column) -> Column:
    """The longest tau of an array of temporal levels; unknown levels don't count."""
    by_tau = sorted(set(TAU.values()), reverse=True)
    named = lambda t: F.array(*[F.lit(n) for n, v in TAU.items() if v == t])
    found = F.when(F.arrays_overlap(levels, named(by_tau[0])), by_tau[0])
    for t in by_tau[1:]:
        found = found.when(F.arrays_overlap(levels, named(t)), t)
    return found.otherwise(DEFAULT_TAU)


def tau_text(tau: Column) -> Column:
    whole = lambda n, u: F.concat(F.floor(tau / n).cast("string"), F.lit(u))
    return F.when(tau >= 86400, whole(86400, "d")).when(tau >= 3600, whole(3600, "h")).when(tau >= 60, whole(60, "m")).otherwise(whole(1, "s"))


def rigidity_class(r: Column) -> Column:
    return F.when(r >= 0.9, "crystallized").when(r >= 0.7, "rigid").when(r >= 0.4, "stable").when(r >= 0.2, "fluid").otherwise("volatile")


def link_weight(count: Column, seconds: Column, tau: float = 86400.0) -> Column:
    """Weight of a link by how often and how lately it was seen."""
    return 0.7 * F.log(1 + count) + 0.3 * F.exp(-F.greatest(seconds, F.lit(0.0)) / tau)


def softmax(score: Column, top: Column, total: Column, temperature: float = 0.1) -> Column:
    """Share of a score: ``top`` and ``total`` are the group's largest score and its sum of shifted exponentials."""
    return F.exp((score - top) / temperature) / total


def priority(count: Column, days: Column, known: Column) -> Column:
    """How urgent a waiting word is: often, lately and with known senses; four places."""
    often = F.least(F.lit(1.0), F.sqrt(count / 100.0))
    return F.round(often * F.greatest(F.lit(0.1), 1 - days / 30.0) * F.when(known, 1.0).otherwise(0.5), 4)


def risk_band(score: Column) -> Column:
    return F.when(score < 0.3, "balanced").when(score < 0.6, "moderate").when(score < 0.9, "high").otherwise("severe")


def data_weight(n: Column) -> Column:
    """How much the data count against the structure after n observations."""
    return F.least(F.lit(0.7), n * 0.007)


def level_score(position: Column, levels: Column) -> Column:
    """Score of the level at a position (from 0) of an axis; two places."""
    return F.round((position + 1) / levels, 2)
