"""Token statistics: global (W1), per condition (W2), specific tokens (W3) and resonance of articles (W4).

One article is one row, so each row knows by itself which of its tokens are first of their kind: document
frequencies are plain sums and need no shuffle by article. Every aggregate folds on the map side before it
shuffles by token; hot tokens therefore cost one state per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import entropy_bits, specificity
from tidemark.functions.text import normalized, tokenizer, valid_token
from tidemark.session import written

# How many surface forms a token keeps by name, and the longest of them.
FORMS, LONG = 50, 50
OTHER_KEY, LONG_KEY = "__OTHER__", "__LONG__"
#: Specific tokens kept per condition and side, and the least count (under the condition or overall) to be scored.
TOP_K, MIN_COUNT = 100, 2


def token_rows(df: DataFrame, id_col: str, text_col: str, *keep: str, tokens: str = "hybrid", valid: bool = True, least: int = 1) -> DataFrame:
    """One row per token of each text: ``id_col``, ``keep``, token, surface, pos, first (of its kind in the text).

    ``pos`` numbers all raw tokens from 0. Without ``valid`` every token with a normal form stays. Null and empty
    texts have no row.
    """
    entry = F.transform(tokenizer(tokens)(F.col(text_col)), lambda s, i: F.struct(normalized(s).alias("token"), i.alias("pos"), s.alias("surface")))
    ok = (lambda e: valid_token(e["token"], least)) if valid else (lambda e: e["token"].isNotNull())
    sorted_ = df.select(id_col, *keep, F.sort_array(F.filter(entry, ok)).alias("_e"))
    first = lambda e, i: F.struct(e["token"], e["surface"], e["pos"], ((i == 0) | (F.get("_e", i - 1)["token"] != e["token"])).alias("first"))
    return sorted_.select(id_col, *keep, F.explode(F.transform("_e", first)).alias("_t")).select(id_col, *keep, "_t.*")


def form_of(surface: Column) -> Column:
    return F.when(F.length(surface) > LONG, LONG_KEY).otherwise(surface)


def capped_forms(tokens: DataFrame, id_col: str) -> DataFrame:
    """token, form, n, docs, seen, and what ``tokens`` carries of times: the first forms by arrival by name, the rest as other.

    Arrival is by id, then position.
    """
    timed = [F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.min_by(id_col, F.struct(_late("ts"), id_col)).alias("src")] if "ts" in tokens.columns else []
    by_form = tokens.groupBy("token", form_of(F.col("surface")).alias("form")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("first").cast("long")).alias("docs"), F.min(F.struct(id_col, "pos")).alias("seen"), *timed
    )
    arrival = F.row_number().over(Window.partitionBy("token", F.col("form") == LONG_KEY).orderBy("seen"))
    named = by_form.withColumn("form", F.when((F.col("form") == LONG_KEY) | (arrival <= FORMS), F.col("form")).otherwise(OTHER_KEY))
    again = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("src", F.struct(_late("hi"), "src")).alias("src")] if timed else []
    return named.groupBy("token", "form").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.min("seen").alias("seen"), *again)


def _late(ts: str) -> Column:
    """Order key by which the latest comes first and null last."""
    return F.coalesce(-F.unix_micros(ts), F.lit(2**62))


def global_stats(tokens: DataFrame, id_col: str) -> DataFrame:
    """W1 per token: total_count, document_frequency, entropy, n_forms, top_form, first_seen, last_seen, last_source.

    ``tokens``: rows of ``token_rows`` with a timestamp ``ts``. Entropy is in bits over the capped forms; the top form
    is the most frequent named one, the first seen on a tie; the last source is the smallest id at the latest time.
    """
    named = ~F.col("form").isin(OTHER_KEY, LONG_KEY)
    forms = capped_forms(tokens, id_col)
    g = forms.groupBy("token").agg(
        F.sum("n").alias("total_count"),
        F.sum("docs").alias("document_frequency"),
        F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("_l"),
        F.count(F.lit(1)).alias("n_forms"),
        F.min_by(F.when(named, F.col("form")), F.when(named, F.struct(-F.col("n"), F.col("seen")))).alias("top_form"),
        F.min("lo").alias("first_seen"),
        F.max("hi").alias("last_seen"),
        F.min_by("src", F.struct(_late("hi"), "src")).alias("last_source"),
    )
    return g.withColumn("entropy", entropy_bits(F.col("total_count"), F.col("_l"), F.col("n_forms"))).drop("_l")


def condition_stats(tokens: DataFrame, id_col: str, cond: str = "cond") -> DataFrame:
    """W2 per token and condition: count, doc_freq, entropy over all surface forms, top_form."""
    by_form = tokens.groupBy("token", cond, "surface").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("first").cast("long")).alias("docs"), F.min(F.struct(id_col, "pos")).alias("seen")
    )
    g = by_form.groupBy("token", cond).agg(
        F.sum("n").alias("count"),
        F.sum("docs").alias("doc_freq"),
        F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("_l"),
        F.count(F.lit(1)).alias("_f"),
        F.min_by("surface", F.struct(-F.col("n"), F.col("seen"))).alias("top_form"),
    )
    return g.withColumn("entropy", entropy_bits(F.col("count"), F.col("_l"), F.col("_f"))).drop("_l", "_f")


def scored(pairs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """Specificity of every (token, cond, count) row, less those rare both under the condition and overall.

    Totals come from the rows themselves: a token's count over all conditions, a condition's over all tokens. Tokens
    that a condition lacks score exactly 0 and are no candidates, so they aren't made up. The pairs are written once,
    as they are read for each of the totals: the corpus below them is not tokenised again.
    """
    p = written(pairs.groupBy("token", "cond").agg(F.sum("count").alias("count")), "pairs")
    by_token = p.groupBy("token").agg(F.sum("count").alias("count_all"))
    by_cond = p.groupBy("cond").agg(F.sum("count").alias("total"))
    whole = by_cond.agg(F.sum("total").alias("total_all"))
    j = p.join(by_token, "token").join(by_cond, "cond").join(whole)
    j = j.filter((F.col("total") > 0) & (F.col("total_all") > 0) & ~((F.col("count") < least) & (F.col("count_all") < least)))
    s = specificity(F.col("count"), F.col("total"), F.col("count_all"), F.col("total_all"))
    return j.select("cond", "token", "count", "count_all", "total", "total_all", s.alias("s"))


def specific_tokens(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """W3: the ``k`` most and the ``k`` least specific tokens per condition: cond, side, rank, token, s, count, count_all.

    Ties go by token; a score of 0 is on no side. The rank limit is applied before the shuffle as well.
    """
    side = F.when(F.col("s") > 0, "positive").when(F.col("s") < 0, "negative")
    rank = F.row_number().over(Window.partitionBy("cond", "side").orderBy(F.desc("strength"), "token"))
    sided = scores.withColumn("side", side).filter(F.col("side").isNotNull()).withColumn("strength", F.abs("s"))
    return sided.withColumn("rank", rank).filter(F.col("rank") <= k).drop("strength")


def specificity_summary(scores: DataFrame) -> DataFrame:
    """Per condition how many tokens were compared, and how many lie on each side."""
    whole = scores.select("token", "count_all").distinct().filter(F.col("count_all") >= MIN_COUNT).agg(F.count(F.lit(1)).alias("overall"))
    g = scores.groupBy("cond").agg(
        F.count(F.when(F.col("count_all") < MIN_COUNT, 1)).alias("_own"), F.count(F.when(F.col("s") > 0, 1)).alias("positive_count"), F.count(F.when(F.col("s") < 0, 1)).alias("negative_count")
    )
    return g.join(whole).select("cond", (F.col("overall") + F.col("_own")).alias("total_tokens_compared"), "positive_count", "negative_count")


def resonance(counts: DataFrame, scores: DataFrame, id_col: str) -> DataFrame:
    """W4 in long form: per article and condition the summed score of its tokens (conditions without a hit have no row).

    ``counts``: rows of ``token_rows`` (not only valid ones); ``scores``: cond, token, s of the specific tokens, which
    are at most two times k per condition. An article's tokens fold in its own task first.
    """
    hit = counts.select(id_col, "token").join(scores.select("cond", "token", "s"), "token")
    return hit.groupBy(id_col, "cond").agg(F.sum("s").alias("r"))


def vectors(long: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """W4 as one map per id, also for ids without any hit (empty map); a missing key means 0."""
    maps = long.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("cond", "r"))).alias("resonance_vector"))
    return ids.select(id_col).join(maps, id_col, "left").select(id_col, F.coalesce("resonance_vector", F.expr("cast(map() as map<string,double>)")).alias("resonance_vector"))
