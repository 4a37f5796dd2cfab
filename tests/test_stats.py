"""Statistics on inline articles: anchors, arrival order, partitioning."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import stats as S


def corpus(spark, texts, partitions=2):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"a{i}", t, t0 + dt.timedelta(days=i), ["x", "y"][i % 2], "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, text string, ts timestamp, cond string, token string").repartition(partitions)


def tokens(spark, texts, **kw):
    return S.token_rows(corpus(spark, texts, kw.pop("partitions", 2)), "id", "text", "ts", "cond", **kw)


def test_case_forms_fall_together(spark):
    texts = ["Apple apple", "APPLE", "Apple APPLE apple", None, "", "  "]
    for n in (1, 5):
        got = {r["token"]: r for r in S.global_stats(tokens(spark, texts, partitions=n), "id").collect()}
        a = got["apple"]
        assert (a["total_count"], a["document_frequency"], a["n_forms"], a["top_form"], a["last_source"]) == (6, 3, 3, "Apple", "a2")
        assert a["entropy"] == pytest.approx(math.log2(3))


def test_entropy_anchor(spark):
    w = S.global_stats(tokens(spark, ["Ab Ab Ab AB AB ab"]), "id").first()
    assert round(w["entropy"], 6) == 1.459148 and w["top_form"] == "Ab"


def test_forms_are_capped_by_arrival(spark):
    cased = ["".join(c.upper() if i >> k & 1 else c for k, c in enumerate("abcdef")) for i in range(60)]
    got = {r["form"]: r["n"] for r in S.capped_forms(tokens(spark, [" ".join(cased), "x" * 60]), "id").collect()}
    assert got[S.OTHER_KEY] == 10 and got[S.LONG_KEY] == 1 and sum(k in got for k in cased[:50]) == 50


def test_specificity_anchor(spark):
    # 3 of 10 under the condition against 4 of 40 overall, 1 of 10 against 8 of 40.
    rows = [("t", "c", 3), ("t", "d", 1), ("u", "c", 1), ("u", "d", 7), ("v", "c", 6), ("v", "d", 22)]
    s = {(r["cond"], r["token"]): r["s"] for r in S.scored(spark.createDataFrame(rows, "token string, cond string, count long")).collect()}
    assert s["c", "t"] == pytest.approx(0.329584, abs=1e-6) and s["c", "u"] == pytest.approx(-0.069315, abs=1e-6)


def test_ranks_and_least_counts(spark):
    rows = [("a", "c", 5), ("b", "c", 5), ("rare", "c", 1), ("a", "d", 1), ("z", "d", 9)]
    s = S.scored(spark.createDataFrame(rows, "token string, cond string, count long"))
    assert "rare" not in {r["token"] for r in s.collect()}
    top = [(r["side"], r["rank"], r["token"]) for r in S.specific_tokens(s, 1).filter("cond = 'c'").collect()]
    assert ("positive", 1, "b") in top and len(top) <= 2
    assert S.specific_tokens(s.limit(0)).collect() == []


def test_resonance_and_vectors(spark):
    t = tokens(spark, ["good good bad", "none here"], valid=False)
    scores = spark.createDataFrame([("c", "good", 0.5), ("c", "bad", -0.25), ("d", "bad", 1.0)], "cond string, token string, s double")
    long = S.resonance(t, scores, "id")
    assert {(r["id"], r["cond"]): r["r"] for r in long.collect()} == {("a0", "c"): 0.75, ("a0", "d"): 1.0}
    v = {r["id"]: r["resonance_vector"] for r in S.vectors(long, corpus(spark, ["", ""]), "id").collect()}
    assert v == {"a0": {"c": 0.75, "d": 1.0}, "a1": {}}


def test_kept_columns_may_not_hide_tokens(spark):
    d = corpus(spark, ["one two"]).drop("token")
    assert S.token_rows(d, "id", "text").columns == ["id", "token", "surface", "pos", "first"]
    assert S.token_rows(d.limit(0), "id", "text").agg(F.count("*")).first()[0] == 0
