"""Condensation of vectors into islands (W5) and the report on each island (W6), scope by scope.

A scope is a named set of articles with its own link threshold; all scopes are worked in one plan. Similarities come
from a join on (scope, dimension), so only articles that share a dimension meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.canonical import digest, ids_digest, island_id, json_array, json_object, pair_id, quoted
from tidemark.operators.components import least_labels
from tidemark.session import written

# Fixed values of the report.
DIGEST_K, EVIDENCE_K, ARTICLE_K, TOPOLOGY_K, SNIPPET = 10, 20, 3, 10, 200
TINY = 1e-12


def current_vectors(w4: DataFrame) -> DataFrame:
    """The latest row of each article: article_id, w4_analysis_id, resonance_vector, used_w3 (ties by run)."""
    v = F.struct("w4_analysis_id", "resonance_vector", "used_w3")
    order = F.struct("computed_at", F.coalesce("w4_run_id", F.lit("")))
    return w4.filter(F.col("article_id").isNotNull()).groupBy("article_id").agg(F.max_by(v, order).alias("v")).select("article_id", "v.*")


def repeated_ids(w4: DataFrame) -> DataFrame:
    """Articles with several rows in a batch (a condensation must not see an article twice)."""
    return w4.groupBy("article_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def entries(vectors: DataFrame) -> DataFrame:
    """article_id, dim, v: the entries of each vector, zeros and nulls left out."""
    e = vectors.select("article_id", F.explode("resonance_vector").alias("dim", "v"))
    return e.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") != 0))


def magnitude(vector: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(vector), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)) * F.coalesce(x, F.lit(0.0))))


def links(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """scope, a, b, sim: pairs of a scope's articles, a < b, whose cosine (12 places) reaches the scope's threshold.

    ``members``: scope, threshold, article_id, each article once per scope.
    """
    unit = vectors.withColumn("_n", magnitude(F.col("resonance_vector"))).filter(F.col("_n") >= TINY)
    e = entries(unit.select("article_id", F.transform_values("resonance_vector", lambda k, v: v / F.col("_n")).alias("resonance_vector")))
    m = members.select("scope", "threshold", "article_id").join(e, "article_id")
    a = m.select("scope", "threshold", "dim", F.col("article_id").alias("a"), F.col("v").alias("va"))
    b = m.select("scope", "dim", F.col("article_id").alias("b"), F.col("v").alias("vb"))
    pairs = a.join(b, ["scope", "dim"]).filter("a < b")
    sim = pairs.groupBy("scope", "threshold", "a", "b").agg(F.round(F.sum(F.col("va") * F.col("vb")), 12).alias("sim"))
    return sim.filter(F.col("sim") >= F.col("threshold")).select("scope", "a", "b", "sim")


def membership(members: DataFrame, vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """scope, article_id, first, size, in_island for every member that has a row of vectors.

    ``first`` is the smallest id of the component; ``in_island`` says whether the component is large enough.
    """
    both = edges.select(F.struct("scope", F.col("b").alias("id")).alias("u"), F.struct("scope", F.col("a").alias("id")).alias("v"))
    label = least_labels(both).select(F.col("node.scope").alias("scope"), F.col("node.id").alias("article_id"), F.col("label.id").alias("first"))
    there = members.join(vectors.select("article_id"), "article_id")
    m = there.join(label, ["scope", "article_id"], "left").withColumn("first", F.coalesce("first", "article_id"))
    size = m.groupBy("scope", "first").agg(F.count(F.lit(1)).alias("size"))
    return m.join(size, ["scope", "first"]).select("scope", "article_id", "first", "size", (F.col("size") >= F.col("min_size")).alias("in_island"))


class Condensed:
    """The parts of the condensation of all scopes; each is a DataFrame made when asked for.

    ``members``: scope, threshold, min_size, article_id; ``w4``: stored projections.
    """

    def __init__(self, members: DataFrame, w4: DataFrame):
        self.vectors = written(current_vectors(w4), "vectors")
        self.members = members.distinct()
        self.edges = written(links(self.members, self.vectors), "links")
        self.membership = written(membership(self.members, self.vectors, self.edges), "membership")
        self.inside = self.membership.filter("in_island")

    def islands(self) -> DataFrame:
        """scope, island_id, first, size, cohesion: mean similarity of the links inside, 6 places."""
        ids = self.inside.groupBy("scope", "first").agg(island_id(F.collect_list("article_id")).alias("island_id"), F.count(F.lit(1)).alias("size"))
        of = self.inside.select("scope", F.col("article_id").alias("a"), "first")
        cohesion = self.edges.join(of, ["scope", "a"]).groupBy("scope", "first").agg(F.round(F.avg("sim"), 6).alias("cohesion"))
        return ids.join(cohesion, ["scope", "first"], "left").select("scope", "island_id", "first", "size", F.coalesce("cohesion", F.lit(1.0)).alias("cohesion"))

    def noise(self) -> DataFrame:
        return self.membership.filter("not in_island").select("scope", "article_id")

    def centroids(self) -> DataFrame:
        """scope, first, dim, v: mean of all members (a missing dimension counts 0), 9 places."""
        e = self.vectors.select("article_id", F.explode("resonance_vector").alias("dim", "v"))
        m = self.inside.join(e, "article_id")
        return m.groupBy("scope", "first", "size", "dim").agg(F.sum("v").alias("_s")).select("scope", "first", "dim", F.round(F.coalesce("_s", F.lit(0.0)) / F.col("size"), 9).alias("v"))

    def structures(self) -> DataFrame:
        """scope, structure_id, input, island and noise counts: an id of the scope's inputs and settings."""
        there = self.members.join(self.vectors.select("article_id", "w4_analysis_id"), "article_id")
        g = there.groupBy("scope", "threshold", "min_size").agg(F.sort_array(F.collect_list("w4_analysis_id")).alias("_w"), F.count(F.lit(1)).alias("input_count"))
        parts = {
            "input_w4_ids": json_array(F.col("_w")),
            "threshold": F.col("threshold").cast("string"),
            "min_island_size": F.col("min_size").cast("string"),
            "algorithm": quoted(F.lit("ResonanceCondensation-v1")),
            "vector_policy": quoted(F.lit("mean_raw_v1")),
        }
        n = self.membership.groupBy("scope").agg(
            F.count(F.when(~F.col("in_island"), 1)).alias("noise_count"), F.count_distinct(F.when(F.col("in_island"), F.col("first"))).alias("island_count")
        )
        return g.select("scope", digest(json_object(parts)).alias("structure_id"), "input_count").join(n, "scope")

    def vector_digest(self, k: int = DIGEST_K) -> DataFrame:
        """scope, first, rank, dim, v: the centroid's largest entries by absolute value, then by dimension."""
        w = Window.partitionBy("scope", "first").orderBy(F.desc(F.abs("v")), "dim")
        return self.centroids().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def evidence(self, scores: DataFrame, k: int = EVIDENCE_K) -> DataFrame:
        """scope, first, rank, token, score, presence: mean score over (member, condition) occurrences.

        ``scores``: cond, token, s. Members are counted per condition first, so a token meets each (island,
        condition) once, not once per member.
        """
        keys = self.vectors.select("article_id", F.explode(F.map_keys("resonance_vector")).alias("cond"))
        n = self.inside.join(keys, "article_id").groupBy("scope", "first", "cond").agg(F.count(F.lit(1)).alias("n"))
        t = n.join(scores.select("cond", "token", "s"), "cond").groupBy("scope", "first", "token")
        t = t.agg(F.round(F.sum(F.col("n") * F.col("s")) / F.sum("n"), 12).alias("score"), F.sum("n").alias("presence"))
        w = Window.partitionBy("scope", "first").orderBy(F.desc(F.abs("score")), "token")
        return t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def used_analyses(self) -> DataFrame:
        """scope, first, used_w3_digest: digest of all analyses the members were projected with."""
        m = self.inside.join(self.vectors.select("article_id", F.explode(F.map_values("used_w3")).alias("w3")), "article_id")
        return m.groupBy("scope", "first").agg(ids_digest(F.collect_set("w3")).alias("used_w3_digest"))

    def representatives(self, articles: DataFrame, k: int = ARTICLE_K) -> DataFrame:
        """scope, first, rank, article_id, w4_analysis_id, magnitude, snippet: the members of largest magnitude.

        ``articles``: article_id, text, each article once; members without an article are left out.
        """
        m = self.inside.join(self.vectors.select("article_id", "w4_analysis_id", F.round(magnitude(F.col("resonance_vector")), 9).alias("magnitude")), "article_id")
        m = m.join(articles.select("article_id"), "article_id", "left_semi")
        w = Window.partitionBy("scope", "first").orderBy(F.desc("magnitude"), "article_id")
        top = m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        # Texts are fetched for the chosen members only.
        return top.join(articles.select("article_id", F.left(F.coalesce("text", F.lit("")), F.lit(SNIPPET)).alias("snippet")), "article_id")

    def topology(self, k: int = TOPOLOGY_K) -> DataFrame:
        """scope, rank, pair_id, island_a, island_b, distance: the closest pairs of a scope's islands by cosine distance.

        Islands of a scope are few; a pair without a common dimension has distance 1, a vector of no length 2.
        """
        c = self.centroids().groupBy("scope", "first").agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("c"))
        i = self.islands().select("scope", "first", "island_id").join(c, ["scope", "first"])
        a = i.select("scope", F.col("island_id").alias("island_a"), F.col("c").alias("ca"))
        b = i.select("scope", F.col("island_id").alias("island_b"), F.col("c").alias("cb"))
        p = a.join(b, "scope").filter("island_a < island_b")
        dot = F.aggregate(F.map_entries("ca"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("cb", e["key"]), F.lit(0.0)))
        na, nb = magnitude(F.col("ca")), magnitude(F.col("cb"))
        distance = F.when((na < TINY) | (nb < TINY), F.lit(2.0)).otherwise(F.round(1 - F.round(dot / (na * nb), 12), 12))
        p = p.select("scope", pair_id(F.col("island_a"), F.col("island_b")).alias("pair_id"), "island_a", "island_b", distance.alias("distance"))
        w = Window.partitionBy("scope").orderBy(F.round("distance", 9), "pair_id")
        return p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def observations(self) -> DataFrame:
        """scope, observation_id: id of the report, of the structure and its islands alone."""
        i = self.islands().groupBy("scope").agg(F.sort_array(F.collect_list("island_id")).alias("_i"))
        s = self.structures().join(i, "scope", "left")
        parts = {
            "structure_id": quoted(F.col("structure_id")),
            "island_ids": json_array(F.coalesce("_i", F.expr("cast(array() as array<string>)"))),
            "scope_id": quoted(F.col("scope")),
            "tokenizer_version": quoted(F.lit("hybrid_v1")),
            "normalizer_version": quoted(F.lit("v9.1.0")),
            "code_version": quoted(F.lit("v5.4.8-MIG.3")),
        }
        return s.select("scope", digest(json_object(parts)).alias("observation_id"), "structure_id", "island_count", "noise_count")


def outside_scope(members: DataFrame, w4: DataFrame, articles: DataFrame) -> DataFrame:
    """scope, article_id, missing: members that have no projection or no article (a closed scope gives no row)."""
    m = members.select("scope", "article_id").distinct()
    no_w4 = m.join(w4.select("article_id"), "article_id", "left_anti").withColumn("missing", F.lit("projection"))
    no_article = m.join(articles.select("article_id"), "article_id", "left_anti").withColumn("missing", F.lit("article"))
    return no_w4.unionByName(no_article)
