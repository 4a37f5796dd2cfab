"""Keyword-stuffed and link-list pages by bagged trees on content and link features.

The words that bind sentences are learned from the corpus first. The trees are fitted on weak labels that clear-cut
pages give themselves; page probabilities are then smoothed by the spam rate of the page's host. Every whole text is
read once for the words and once for the features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.page_features import FEATURES, common_counts, is_character, page_features
from tidemark.llm.trees import fit_bagged, predict
from tidemark.session import written

#: Weakly labelled pages per class that the trees are fitted on (the only sample; all pages are scored).
SAMPLE = 4000
#: Share of a group's texts from which on a word, or a character of a script without spaces, is common.
COMMON_WORD, COMMON_CHARACTER = 0.25, 0.5
#: Pages a host's rate is drawn towards the overall rate by, and the weight of the host in log-odds.
HOST_PRIOR, HOST_WEIGHT = 50.0, 0.25
#: Up to this many hosts their rates are broadcast; more are joined, each host's pages dealt to this many keys.
HOSTS_TO_BROADCAST, SALT = 50_000, 32
#: Characters of text worked at once inside a batch.
CHUNK = 4_000_000


def weak_label() -> F.Column:
    """1 for pages that are clearly stuffed or lists of links, 0 for clear prose and informing lists, else null.

    Bound sentences, varied text, and lists with figures in most lines that don't keep repeating their words are no
    spam; links or tags for the most part, stuffed sentences, and loose words that repeat themselves are.
    """
    c = F.col
    linked = c("link_share") + c("tag_share")
    calm = c("stuffed_share") < 0.1
    fine = (
        ((c("bound_share") > 0.7) & (linked < 0.2) & calm)
        | ((c("bound_share") > 0.5) & (linked < 0.5) & (c("stuffed_share") < 0.2))
        | ((c("number_units") > 0.6) & (linked < 0.2) & (c("pairs_thrice") < 0.25) & calm)
        | ((c("squeezed") > 0.55) & (linked < 0.45) & (c("pairs_thrice") < 0.1) & calm)
    )
    loose = c("bound_share") < 0.5
    repeats = (c("pairs_thrice") > 0.3) | ((c("top_token") > 0.1) & (c("number_units") < 0.6))
    spam = ((linked > 0.45) & loose) | (c("stuffed_share") > 0.45) | (loose & repeats & (c("squeezed") < 0.42))
    return F.when(fine, 0).when(spam & (c("log_chars") > 0), 1)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of a batch with a bounded amount of text each (a single text may be larger)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.cumsum(sizes) // CHUNK
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
    yield from zip(edges, edges[1:])


def common_words(df: DataFrame, text_col: str, group_cols: Sequence[str] = ()) -> frozenset[str]:
    """Words and characters that stand in a large share of some group's texts, by all texts of the corpus.

    A share is taken at the lower end of what its count allows, so a group of few texts has none. At most as many
    words come to the driver as fill the texts' own length a few times over, whatever the size of the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in _chunks(b.column(0)):
                g, w, n = common_counts(b.column(0).slice(i, j - i).to_pylist(), b.column(1).slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["g", "w", "n"])

    group = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group_cols]) if group_cols else F.lit("")
    counts = df.select(F.col(text_col).alias("t"), group.alias("g")).mapInArrow(run, "g string, w string, n long").groupBy("g", "w").agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    whole = counts.filter("w = ''").select("g", F.col("n").alias("all"))
    sure = (F.col("n") - 2 * F.sqrt("n")) / F.col("all")
    often = counts.filter("w <> ''").join(whole, "g").filter(sure >= min(COMMON_WORD, COMMON_CHARACTER)).groupBy("w").agg(F.max(sure).alias("s")).collect()
    return frozenset(r["w"] for r in often if r["s"] >= (COMMON_CHARACTER if is_character(r["w"]) else COMMON_WORD))


def _features(df: DataFrame, id_col: str, text_col: str, host_col: str, common: frozenset[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in _chunks(b.column(1)):
                x = page_features(b.column(1).slice(i, j - i).to_pylist(), common)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(FEATURES)))], names=["_id", "_host", *FEATURES])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(host_col).cast("string").alias("_host"))
    return rows.mapInArrow(run, f"_id {kind}, _host string, " + ", ".join(f"{f} double" for f in FEATURES))


def page_scores(df: DataFrame, id_col: str, text_col: str, host_col: str, group_cols: Sequence[str] = (), sample: int = SAMPLE) -> DataFrame:
    """One row per page: ``id_col``, page_probability, host_rate, probability (smoothed).

    ``group_cols`` name what texts of one kind of language share; null is a group of its own. Null and blank texts have
    probability 0. Pages without a host are smoothed by the overall rate. Where no page gives a weak label of one
    class, every probability is 0. An empty table gives no row; repeated rows are each scored; very long texts are
    read whole.
    """
    kept = written(_features(df, id_col, text_col, host_col, common_words(df, text_col, group_cols)), "pages")
    labelled = kept.withColumn("_label", weak_label())
    # The smallest hashes of each class: the same pages whatever the partitioning.
    picked = [
        labelled.filter(F.col("_label") == k).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(sample).select("_label", *FEATURES)
        for k in (0, 1)
    ]
    got = [np.array([tuple(r) for r in p.collect()], float).reshape(-1, len(FEATURES) + 1) for p in picked]
    fit = np.concatenate(got)
    forest = fit_bagged(fit[:, 1:], fit[:, 0]) if all(len(g) for g in got) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))])
            p = predict(forest, x) if forest else np.zeros(len(x))
            p[x.sum(1) == 0] = 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p)], names=["_id", "_host", "p"])

    kind = kept.schema["_id"].dataType.simpleString()
    pages = written(kept.mapInArrow(run, f"_id {kind}, _host string, p double"), "scored")
    hosts = written(pages.groupBy("_host").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n")), "hosts")
    total = hosts.agg(F.sum("s"), F.sum("n"), F.count(F.lit(1))).first()
    overall = float(total[0] or 0.0) / max(1, total[1] or 0)
    rates = hosts.filter(F.col("_host").isNotNull()).select("_host", ((F.col("s") + HOST_PRIOR * overall) / (F.col("n") + HOST_PRIOR)).alias("host_rate"))
    if total[2] <= HOSTS_TO_BROADCAST:
        joined = pages.join(F.broadcast(rates), "_host", "left")
    else:
        # A host with a tenth of all pages, and the pages without one, are dealt to many keys.
        salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = pages.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALT)).cast("int")).join(salted, ["_host", "_salt"], "left")
    joined = joined.withColumn("host_rate", F.coalesce("host_rate", F.lit(overall)))

    def odds(c: F.Column) -> F.Column:
        q = F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
        return F.ln(q / (1 - q))

    z = odds(F.col("p")) + HOST_WEIGHT * (odds(F.col("host_rate")) - odds(F.lit(overall)))
    smooth = F.when(F.col("p") > 0, 1 / (1 + F.exp(-z))).otherwise(F.lit(0.0))
    return joined.select(F.col("_id").alias(id_col), F.col("p").alias("page_probability"), "host_rate", smooth.alias("probability"))


def spam_pages(df: DataFrame, id_col: str, text_col: str, host_col: str, group_cols: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Ids of the pages whose smoothed probability exceeds ``threshold``."""
    return page_scores(df, id_col, text_col, host_col, group_cols).filter(F.col("probability") > threshold).select(id_col)
