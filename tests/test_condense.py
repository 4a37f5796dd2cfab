"""Condensation and report on known vectors."""

import datetime as dt

import pytest

from tidemark.operators.components import least_labels
from tidemark.operators.condense import Condensed, links, outside_scope, repeated_ids

W4 = "article_id string, w4_analysis_id string, w4_run_id string, computed_at timestamp, resonance_vector map<string,double>, used_w3 map<string,string>"
T0 = dt.datetime(2024, 1, 1)


def w4(spark, vectors, again=()):
    rows = [(k, f"w-{k}", "r", T0, v, {c: f"w3-{c}" for c in v or {}}) for k, v in vectors.items()]
    rows += [(k, f"old-{k}", "r", T0 - dt.timedelta(days=1), {"x": 1.0}, {}) for k in again]
    return spark.createDataFrame(rows, W4)


VECTORS = {
    "n1": {"news": 0.8, "dialog": -0.3},
    "n2": {"news": 0.7, "dialog": -0.2},
    "n3": {"news": 0.6, "dialog": -0.25},
    "d1": {"news": -0.4, "dialog": 0.6},
    "d2": {"news": -0.3, "dialog": 0.5},
    "d3": {"news": -0.5, "dialog": 0.7},
    "q1": {"news": 0.5, "dialog": 0.5},
    "e1": {},
}


def members(spark, ids, scope="s", threshold=0.7, least=3):
    return spark.createDataFrame([(scope, threshold, least, i) for i in ids], "scope string, threshold double, min_size int, article_id string")


@pytest.fixture(scope="module")
def done(spark):
    m = members(spark, [*VECTORS, "gone"]).union(members(spark, ["n1", "n2"], "t"))
    return Condensed(m, w4(spark, VECTORS, ["n1"]))


def test_two_islands_and_noise(done):
    got = [(r["scope"], r["first"], r["size"]) for r in done.islands().orderBy("first").collect()]
    assert got == [("s", "d1", 3), ("s", "n1", 3)] and all(r["cohesion"] > 0.99 for r in done.islands().collect())
    assert sorted((r["scope"], r["article_id"]) for r in done.noise().collect()) == [("s", "e1"), ("s", "q1"), ("t", "n1"), ("t", "n2")]


def test_centres_topology_and_magnitudes(done, spark):
    c = {(r["first"], r["dim"]): r["v"] for r in done.centroids().collect()}
    assert c["n1", "news"] == 0.7 and c["n1", "dialog"] == -0.25 and c["d1", "news"] == -0.4 and c["d1", "dialog"] == 0.6
    assert [round(r["distance"], 6) for r in done.topology().collect()] == [1.802233]
    articles = spark.createDataFrame([("n1", "x" * 300), ("n2", None), ("d1", "t")], "article_id string, text string")
    top = [(r["first"], r["rank"], r["article_id"], len(r["snippet"])) for r in done.representatives(articles).orderBy("first", "rank").collect()]
    assert top == [("d1", 1, "d1", 1), ("n1", 1, "n1", 200), ("n1", 2, "n2", 0)]


def test_evidence_means_over_members_and_conditions(done, spark):
    scores = spark.createDataFrame([("news", "prime", 0.03), ("dialog", "prime", -0.015), ("news", "policy", 0.035)], "cond string, token string, s double")
    e = {(r["first"], r["token"]): (r["rank"], r["score"], r["presence"]) for r in done.evidence(scores).collect()}
    assert e["n1", "policy"] == (1, 0.035, 3) and e["n1", "prime"] == (2, 0.0075, 6)


def test_ids_depend_on_members_alone(done, spark):
    again = Condensed(members(spark, list(VECTORS)[::-1]), w4(spark, dict(reversed(VECTORS.items()))).repartition(5))
    ids = lambda c: sorted(r["island_id"] for r in c.islands().filter("scope = 's'").collect())
    assert ids(done) == ids(again)
    assert {r["structure_id"] for r in done.structures().filter("scope = 's'").collect()} == {r["structure_id"] for r in again.structures().collect()}


def test_guards(spark):
    d = w4(spark, VECTORS, ["n1", "n2"])
    assert sorted(r["article_id"] for r in repeated_ids(d).collect()) == ["n1", "n2"]
    out = outside_scope(members(spark, ["n1", "zz"]), d, spark.createDataFrame([("zz",)], "article_id string"))
    assert sorted((r["article_id"], r["missing"]) for r in out.collect()) == [("n1", "article"), ("zz", "projection")]


def test_empty_scope(spark):
    c = Condensed(members(spark, []), w4(spark, {}))
    assert c.islands().collect() == [] and c.topology().collect() == [] and c.structures().collect() == []


def test_threshold_counts_after_rounding(spark):
    from tidemark.operators.condense import current_vectors

    v = current_vectors(w4(spark, {"a": {"x": 1.0}, "b": {"x": 0.7, "y": (1 - 0.49) ** 0.5}}))
    assert links(members(spark, ["a", "b"]), v).count() == 1


def test_components_of_structs_and_loops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("f", "e")], "u string, v string")
    assert sorted(tuple(r) for r in least_labels(e).collect()) == [("b", "a"), ("c", "a"), ("f", "e")]
    assert least_labels(e.limit(0)).collect() == []
