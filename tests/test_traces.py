"""Traces, policies, registry, comparison and audit aggregates on small rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical as C
from tidemark.functions import routing as R
from tidemark.functions import traces as T
from tidemark.operators import audit as A
from tidemark.operators import registry as G
from tidemark.operators.compare import differences
from tidemark.operators.conditions import ConditionPolicy, context_id, current_articles, traces_of


def dump(x, spaced=False):
    return json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(", ", ": ") if spaced else (",", ":"))


def sha(x, size=64):
    return hashlib.sha256(x.encode()).hexdigest()[:size]


@pytest.mark.parametrize(
    "key, error",
    [
        ("html:has_h1", None),
        ("legacy:source_type", None),
        ("meta:source_type", "forbidden_name"),
        ("topic:x", "forbidden_namespace"),
        ("a", "no_separator"),
        ("a:b:c", "many_separators"),
        (":b", "empty_namespace"),
        ("a:", "empty_name"),
        ("A:b", "characters"),
        ("a:label", None),
        (None, "not_text"),
    ],
)
def test_keys(spark, key, error):
    assert spark.createDataFrame([(key,)], "k string").select(T.key_error(F.col("k"))).first()[0] == error


def test_values(spark):
    d = spark.createDataFrame([(float("nan"), 2**31, "x" * 4097), (float("-inf"), -(2**31), "x"), (1.23456789012, 5, None)], "f double, i long, s string")
    got = d.select(T.float_error("f" if False else F.col("f")), T.int_error(F.col("i")), T.text_error(F.col("s")), T.normal_int(F.col("i")), F.length(T.normal_text(F.col("s")))).collect()
    assert [tuple(r) for r in got] == [("nan", "out_of_range", "too_long", 2**31 - 1, 4096), ("infinite", None, None, -(2**31), 1), (None, None, None, 5, None)]


def test_traces_and_ids(spark):
    rows = [("a", {"Source_Type": "news", "source_type": "paper", "x": None}, "http://u/é\"q"), ("b", None, None), ("c", {}, None)]
    d = spark.createDataFrame(rows, "id string, m map<string,string>, url string").withColumn("t", traces_of(F.col("m"), F.col("url")))
    got = {r["id"]: r for r in d.select("id", "t", "url", context_id(F.col("t"), F.col("url")).alias("c")).collect()}
    assert got["a"]["t"] == {"legacy:source_type": "paper", "meta:retrieval_url": "http://u/é\"q"} and got["b"]["t"] == got["c"]["t"] == {}
    for r in got.values():
        assert r["c"] == sha(dump({"capture_version": "v1", "retrieval_path": r["url"], "traces": r["t"]}), 32)


def test_signatures(spark):
    d = spark.createDataFrame([({"b:k": "2", "a:k": "1"},), ({"a:k": "unknown"},), ({},)], "t map<string,string>")
    p = ConditionPolicy("p", ("b:k", "a:k"))
    got = [r[0] for r in d.select(p.signature(F.col("t"))).collect()]
    want = [{"factors": f, "missing": m, "policy_id": "p", "version": "v1.0"} for f, m in (({"a:k": "1", "b:k": "2"}, []), ({"a:k": "unknown"}, ["b:k"]), ({}, ["a:k", "b:k"]))]
    assert got == [sha(dump(w)) for w in want]
    others = [ConditionPolicy("q", ("b:k", "a:k")), ConditionPolicy("p", ("b:k", "a:k"), "v2")]
    assert len({d.select(x.signature(F.col("t"))).first()[0] for x in (p, *others)}) == 3


def test_record_and_island_ids(spark):
    r = spark.range(1).select(
        C.record_id(F.lit('a"語'), F.lit("c")).alias("r"), C.island_id(F.array(F.lit("b"), F.lit("a"))).alias("i"), C.legacy_signature(F.lit("news"), F.lit("en"), F.lit("2024-01")).alias("l"), C.old_signature(F.create_map(F.lit("k"), F.lit("v"))).alias("o")
    ).first()
    assert r["r"] == sha(dump({"cond": "c", "token_norm": 'a"語'}, True), 32) and r["i"] == sha(dump({"members": ["a", "b"]}))
    assert r["l"] == sha(dump({"source_type": "news", "language_profile": "en", "time_bucket": "2024-01"})) and r["o"] == sha(dump({"k": "v"}, True), 32)


def test_current_articles(spark):
    d = spark.createDataFrame(
        [("a", 1, "u1", "2024-01-01", {"k": "1"}, None), ("a", 1, "u2", "2024-02-01", None, "s"), ("a", 1, "u3", None, None, None)],
        "article_id string, doc_id long, source_url string, ingestion_time string, source_meta map<string,string>, substrate_ref string",
    ).withColumn("ingestion_time", F.to_timestamp("ingestion_time"))
    assert [r["source_url"] for r in current_articles(d).collect()] == ["u2"]


def test_registry(spark):
    c = spark.createDataFrame([("1", {"legacy:a": "x"}, "p"), ("1", {"legacy:a": "x"}, "p"), ("2", {"meta:b": "y"}, None)], "context_id string, traces map<string,string>, retrieval_path string")
    r = G.registered(c)
    assert sorted((x["context_id"], x["times"]) for x in r.collect()) == [("1", 2), ("2", 1)]
    assert [x["context_id"] for x in G.with_trace(r, "legacy:a", None).collect()] == ["2"] and [x["context_id"] for x in G.with_namespace(r, "legacy").collect()] == ["1"]
    assert sorted(map(tuple, G.namespace_summary(r).collect())) == [("legacy", 1), ("meta", 1)]
    assert G.new_contexts(c, r).count() == 0


def test_differences(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, 3.0, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-10, "x"), (2, 2.5, None), (4, 1.0, "z")], "k int, v double, s string")
    got = sorted((r["k"], r["difference"], r["fields"]) for r in differences(a, b, ["k"], ["v", "s"], 1e-8).collect())
    assert got == [(2, "changed", "v"), (3, "missing_right", None), (4, "missing_left", None)]
    assert differences(a, a, ["k"], ["v", "s"]).count() == 0


def test_spread_and_drift(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (10.0,), (None,)], "v double")
    r = A.spread(d, "v").first()
    assert r["p80"] == pytest.approx(5.2) and (r["n"], r["missing"], r["high_rate"]) == (4, 1, 1.0)
    runs = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("c", None), ("c", "x")], "i string, o string")
    assert {r["i"]: r["drift"] for r in A.drift_scores(runs, "i", "o").collect()} == {"a": 0.5, "b": 0.0, "c": 1.0}


def test_decision_anchors(spark):
    ask = lambda *s: spark.range(1).select(R.decision(F.array(*map(F.lit, s))).alias("d")).first()["d"]
    a, b, z = ask(0.0, 0.3, 0.35, 0.9), ask(0.0, 0.3, 0.6, 0.05), ask(0.0, 0.0, 0.0, 0.0)
    assert (a["winner"], round(a["margin"], 3), round(a["entropy"], 3)) == (None, 0.355, 0.970)
    assert (b["winner"], round(b["margin"], 3), round(b["entropy"], 3)) == ("C", 0.316, 0.809) and z["winner"] is None


def test_conflict(spark):
    s = lambda *v: spark.range(1).select(R.sense_conflict(F.array(*map(F.lit, v)))).first()[0]
    assert float(s(0.9, 0.1, 0.1)) == 0.1 and float(s(0.5, 0.45)) == 0.9 and float(s(0.5, 0.45, 0.2)) == 1.0
