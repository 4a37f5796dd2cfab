"""Edges between concepts and vectors: cosine to concept centres, diverse top lists, softmax weights, ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import softmax
from tidemark.session import small

CONCEPTS = 10_000


def centres(vectors: DataFrame, concept: str, vector: str) -> DataFrame:
    """concept, centre: mean vector of each concept."""
    e = vectors.filter(F.col(concept).isNotNull()).select(concept, F.posexplode(vector).alias("i", "x"))
    m = e.groupBy(concept, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy(concept).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b)))


def concept_edges(vectors: DataFrame, ident: str, vector: str, centre: DataFrame, concept: str, least: float, k: int) -> DataFrame:
    """ident, concept, raw_score: up to ``k`` concepts per vector of at least ``least`` cosine, best first (ties by concept).

    Concepts are a dictionary: their centres stand as one array inside every row, so no rows are crossed. More than
    10,000 of them are joined in blocks.
    """
    rows = small(centre, CONCEPTS, concept, "centre")
    if rows is None:
        raise ValueError("more concepts than one block; split the concepts and merge the top lists")
    c = F.array(*[F.struct(F.lit(r[0]).alias("concept"), F.array(*map(F.lit, r[1])).alias("v")) for r in rows])
    scored = F.transform(c, lambda x: F.struct((-F.round(cosine(F.col(vector), x["v"]), 12)).alias("n"), x["concept"].alias("concept")))
    top = F.slice(F.sort_array(F.filter(scored, lambda x: x["n"] <= -least)), 1, k)
    return vectors.select(ident, F.explode(top).alias("e")).select(ident, F.col("e.concept").alias(concept), (-F.col("e.n")).alias("raw_score"))


def diverse_top(candidates: DataFrame, by: str, group: str, score: str, tie: str, k: int, per_group: int = 1) -> DataFrame:
    """The ``k`` best of each ``by`` with at most ``per_group`` of one ``group``, with their rank."""
    inner = Window.partitionBy(by, group).orderBy(F.desc(score), tie)
    outer = Window.partitionBy(by).orderBy(F.desc(score), tie)
    c = candidates.withColumn("_g", F.row_number().over(inner)).filter(F.col("_g") <= per_group)
    return c.withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= k).drop("_g")


def weighted(edges: DataFrame, by: str, temperature: float = 0.1) -> DataFrame:
    """Edges with ``weight``, the softmax of their raw scores within each ``by``."""
    w = Window.partitionBy(by)
    top = F.max("raw_score").over(w)
    e = edges.withColumn("_t", top)
    total = F.sum(F.exp((F.col("raw_score") - F.col("_t")) / temperature)).over(w)
    return e.withColumn("weight", softmax(F.col("raw_score"), F.col("_t"), total, temperature)).drop("_t")


def most_hit(edges: DataFrame, ident: str, k: int | None = 500) -> DataFrame:
    """ident, hits: how many edges each has; with ``k`` those with most, ties by id."""
    g = edges.groupBy(ident).agg(F.count(F.lit(1)).alias("hits"))
    return g if k is None else g.orderBy(F.desc("hits"), ident).limit(k)


def concept_scores(token_idents: DataFrame, edges: DataFrame, ident: str, concept: str, k: int | None = 5) -> DataFrame:
    """Candidates of each text: text, concept, score (summed raw score times weight, 8 places each), best edge, tokens; ranked.

    ``token_idents``: text, token, ident, each once; ``edges``: ident, concept, raw_score, weight.
    """
    j = token_idents.join(edges, ident)
    part = F.round(F.col("raw_score") * F.col("weight"), 8)
    g = j.groupBy("text", concept).agg(
        F.sum(part).alias("score"), F.max_by(ident, F.struct("raw_score", -F.col(ident) if dict(edges.dtypes)[ident] in ("bigint", "int") else F.col(ident))).alias("best"), F.count_distinct("token").alias("tokens")
    )
    if k is None:
        return g
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("text").orderBy(F.desc(F.round("score", 9)), concept))).filter(F.col("rank") <= k)
