"""Lookups, caches, molecules against a glossary, keyed states, concept edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import edges as E
from tidemark.operators import keyed_state as S
from tidemark.operators import lookup as L

T0 = dt.datetime(2024, 1, 1)


def test_triggers(spark):
    g = spark.createDataFrame([("C", ["Run ", "run", ""]), ("D", ["run", "fast"]), ("E", None)], "concept string, triggers array<string>")
    i = L.trigger_index(g, "concept", "triggers")
    assert sorted(map(tuple, i.collect())) == [("fast", "D"), ("run", "C"), ("run", "D")]
    t = spark.createDataFrame([(1, "Run, run FAST"), (2, None), (3, "none")], "id int, text string")
    assert [tuple(r) for r in L.triggered(t, "id", "text", i, "concept", 5).orderBy("rank").collect()] == [(1, "D", 1.5, 2, 1), (1, "C", 1.0, 1, 2)]


def test_stand_ins(spark):
    e = spark.createDataFrame([("a", "X", 0.9), ("b", "Y", 0.9), ("b", "Z", 0.1), ("c", "X", 0.5)], "s string, concept string, raw_score double")
    r = spark.createDataFrame([("q", "a", "hypernym", 0), ("q", "b", "similar", 0), ("q", "c", "similar", 1), ("w", "a", "similar", 10), ("w", "a", "odd", 0)], "s string, neighbour string, relation string, position int")
    ids = spark.createDataFrame([("a",), ("q",), ("w",)], "s string")
    got = sorted((x["s"], x["source"], x["decay"], x["concept"]) for x in L.with_stand_ins(ids, e, r, "s").collect())
    assert got == [("a", "a", 1.0, "X"), ("q", "b", 0.8, "Y"), ("q", "b", 0.8, "Z")]


def test_cache(spark):
    c = spark.createDataFrame([("k", T0, "old"), ("m", T0 - dt.timedelta(days=8), "old")], "k string, stored_at timestamp, v string")
    now = F.lit(T0 + dt.timedelta(days=1)).cast("timestamp")
    assert [r["k"] for r in L.live(c, now).collect()] == ["k"]
    new = spark.createDataFrame([("m", T0, "new")], c.schema)
    assert {r["k"]: r["v"] for r in L.refreshed(c, new, "k").collect()} == {"k": "old", "m": "new"}


MOLECULE = "id int, formula string, active array<struct<atom:string,axis:string,level:string>>"


def test_molecules(spark):
    levels = spark.createDataFrame([("aa_1", "t", "low")], "atom string, axis string, level string")
    m = spark.createDataFrame(
        [(1, "aa_1 ▷ aa_2", [("aa_1", "t", "low"), ("zz", "t", "low")]), (2, "〈aa_1", [("aa_1", "t", "high")]), (3, None, [("aa_1", None, None)]), (4, "aa_1", [])], MOLECULE
    )
    got = sorted(map(tuple, L.molecule_errors(m, levels, "id").collect()))
    assert got == [(1, "undefined_id", "aa_2"), (1, "unknown_atom", "zz"), (2, "brackets", "〈aa_1"), (2, "unknown_level", "aa_1/t/high"), (4, "undefined_id", "aa_1")]
    a = spark.createDataFrame([(1, "aa_1", "t", "low"), (2, "aa_1", "t", "x"), (3, "aa_1", "x", "low")], "n int, atom string, axis string, level string")
    assert sorted(map(tuple, L.coerced(a, levels).collect()), key=lambda r: r[0]) == [(1, "aa_1", "t", "low", False), (2, "aa_1", "t", None, True), (3, "aa_1", None, None, True)]


def test_states(spark):
    rows = [("k", i, 0.1 * (i % 3) + 0.0125, float(i)) for i in range(14)] + [("m", 1, None, 0.0)]
    d = spark.createDataFrame(rows, "key string, i int, volatility double, seconds double").repartition(4)
    got = {r["key"]: r for r in S.aggregate_states(d, "key", ["i"]).collect()}
    avg = 0.0
    for n, (_, _, v, _) in enumerate(rows[:14]):
        avg = round((avg * n + v) / (n + 1), 3) if n else round(v, 3)
    k = got["k"]
    assert (k["n"], k["first"], k["last"], k["average"], len(k["history"])) == (14, 0.0, 13.0, avg, 10) and k["history"] == [r[2] for r in rows[4:14]]
    assert got["m"]["average"] == 0.0 and [r["key"] for r in S.pending(S.aggregate_states(d, "key", ["i"]), "key", 1).collect()] == ["m"]


def test_diverse_top_and_softmax(spark):
    c = spark.createDataFrame([("q", "g", "a", 0.9), ("q", "g", "b", 0.8), ("q", "h", "c", 0.7), ("q", "i", "d", 0.7)], "by string, grp string, tie string, s double")
    assert [(r["rank"], r["tie"]) for r in E.diverse_top(c, "by", "grp", "s", "tie", 3).orderBy("rank").collect()] == [(1, "a"), (2, "c"), (3, "d")]
    w = E.weighted(c.withColumnRenamed("s", "raw_score"), "by").collect()
    assert sum(r["weight"] for r in w) == pytest.approx(1) and max(w, key=lambda r: r["weight"])["tie"] == "a"
