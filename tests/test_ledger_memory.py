"""Ledger faults, memory against the plain recurrence, index anchors, dynamics."""

import datetime as dt
import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import molecules as MO
from tidemark.functions import scores as SC
from tidemark.operators import dynamics as D
from tidemark.operators import ledger as L
from tidemark.operators import memory as M
from tidemark.operators import semindex as X

T0 = dt.datetime(2024, 1, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("seconds, tau, weight", [(300, 300, 0.367879), (1500, 300, 0.006738), (0, 300, 1.0), (-5, 300, 1.0), (300, 0, 0.367879)])
def test_decay(spark, seconds, tau, weight):
    assert value(spark, SC.decayed(F.lit(1.0), F.lit(float(seconds)), F.lit(float(tau)))) == pytest.approx(weight, abs=1e-6)


def test_reinforce_and_tau(spark):
    assert [value(spark, SC.reinforced(F.lit(w))) for w in (0.5, 0.0, 1.0)] == pytest.approx([0.6, 0.2, 1.0])
    assert [value(spark, SC.tau_of(F.array(*map(F.lit, x)))) for x in (["permanence", "emergence"], ["emergence"], ["?"])] == [86400, 60, 300]
    assert [value(spark, SC.tau_text(F.lit(t))) for t in (86400, 3600, 300, 5)] == ["1d", "1h", "5m", "5s"]


def test_operator_types(spark):
    d = spark.createDataFrame([("aa_1 ▷ aa_2",), ("a ⇒+ b",), ("a ⇒ b",), ("a ⇒+ b ⇒ c",), ("a -|> b × c",), ("a | b",), (None,), ("",)], "f string")
    assert [r[0] for r in d.select(MO.operator_type(F.col("f"))).collect()] == ["▷", "⇒+", "⇒", "⇒+", "-|>|×", "ATOM_ONLY", "ATOM_ONLY", "ATOM_ONLY"]
    sig = MO.formula_signature(F.col("f"), F.array(F.lit("b"), F.lit("a")), F.array().cast("array<string>"))
    assert [r[0] for r in d.select(sig).collect()][-2:] == ["a|b::NONE"] * 2
    assert value(spark, MO.unbalanced(F.lit("〉a〈"))) and not value(spark, MO.unbalanced(F.lit("〈〈a〉〉")))


def replay(events):
    out = {}
    for fp, at, i, tau in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if fp not in out:
            out[fp] = [tau, 1.0, 1, at]
        else:
            s = out[fp]
            s[1] = s[1] * math.exp(-(at - s[3]).total_seconds() / s[0])
            s[1] += 0.2 * (1 - s[1])
            s[2], s[3] = s[2] + 1, at
    return out


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_memory_equals_the_recurrence(spark, parts):
    rng = np.random.default_rng(2)
    events = [("hot" if rng.random() < 0.8 else f"f{rng.integers(9)}", T0 + dt.timedelta(seconds=int(rng.integers(5000))), i, int(rng.choice([60, 300, 3600]))) for i in range(800)]
    d = spark.createDataFrame([*events, (None, T0, 1, 60), ("x", None, 1, 60)], "fingerprint string, at timestamp, event_id long, tau int").repartition(5)
    want = replay(events)
    got = {r["fingerprint"]: r for r in M.replay(d, partitions=parts).collect()}
    assert set(got) == set(want)
    for f, (tau, w, n, last) in want.items():
        assert got[f]["weight"] == pytest.approx(w) and (got[f]["tau"], got[f]["observation_count"], got[f]["last_updated"]) == (tau, n, last)
    later = M.aged(M.replay(d), F.lit(T0 + dt.timedelta(days=3)).cast("timestamp"))
    assert all(r["purge"] == (r["weight"] < 0.01) for r in later.collect()) and M.replay(d.limit(0)).collect() == []


def ledger(spark, n=6):
    rows = [("l1", T0 + dt.timedelta(seconds=i), i, f"t{i}", "molecule.observe", "=>+", json.dumps({"k": i}, separators=(",", ":")), "{}") for i in range(n)]
    d = spark.createDataFrame(rows, "ledger_id string, at timestamp, row_id long, ts string, event_type string, direction string, data string, meta string")
    return L.chained(L.with_genesis(d)).withColumn("line", F.col("seq"))


def codes(d):
    return sorted((r["line"], r["code"]) for r in L.faults(d).collect())


def test_chain_is_that_of_plain_hashing(spark):
    prev = "0" * 64
    for r in ledger(spark).orderBy("seq").collect():
        data = json.loads(r["data"])
        event = {"v": 1, "ledger_id": "l1", "event_type": r["event_type"], "direction": r["direction"], "data": data}
        dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        eid = hashlib.sha256(dump(event).encode()).hexdigest()
        body = {**event, "seq": r["seq"], "ts": r["ts"], "meta": json.loads(r["meta"]), "hash": {"algo": "sha256", "prev": prev, "event_id": eid}}
        own = hashlib.sha256((prev + "\n" + dump(body)).encode()).hexdigest()
        assert (r["event_id"], r["prev"], r["self"]) == (eid, prev, own)
        prev = own


def test_faults(spark):
    d = ledger(spark)
    assert codes(d) == []
    assert codes(d.withColumn("data", F.when(F.col("seq") == 3, F.lit("{}")).otherwise(F.col("data")))) == [(3, "T861")]
    assert codes(d.filter("seq <> 3")) == [(4, "T861"), (4, "T862"), (4, "T864")]
    assert codes(d.withColumn("seq", F.when(F.col("seq") == 6, F.lit(None)).otherwise(F.col("seq")))) == [(6, "T863")]
    assert (2, "T865") in codes(d.withColumn("v", F.when(F.col("seq") == 2, 9).otherwise(F.col("v"))))
    swapped = d.withColumn("line", F.when(F.col("seq") == 2, 3).when(F.col("seq") == 3, 2).otherwise(F.col("seq")))
    assert {c for _, c in codes(swapped)} >= {"T862", "T864"}


def test_rigidity_anchors(spark):
    rows = [(i, ["one"], "f") for i in range(10)] + [(i, ["five"], f"f{i % 5}") for i in range(5)] + [(i, ["mix", "mix"], "g" if i < 7 else "h") for i in range(10)]
    got = {r["atom"]: r for r in X.atom_stats(spark.createDataFrame(rows, "seq long, atoms array<string>, formula_signature string")).collect()}
    assert [got[a]["rigidity"] for a in ("one", "five", "mix")] == pytest.approx([1.0, 0.2, 0.7])
    assert [got[a]["class"] for a in ("one", "five", "mix")] == ["crystallized", "fluid", "rigid"] and got["one"]["alert"] and got["mix"]["count_total"] == 20
    assert got["five"]["mode_formula"] == "f0"


def test_pairs_once_per_event(spark):
    d = spark.createDataFrame([(["b", "a", "b", None],), (["a", "b", "c"],), (["a"],), ([],), (None,)], "atoms array<string>")
    assert sorted(tuple(r) for r in X.cooccurrence(d).collect()) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


@pytest.mark.parametrize("parts", [1, 7])
def test_smoothing(spark, parts):
    rng = np.random.default_rng(9)
    data = [("k" if rng.random() < 0.9 else "m", i, float(rng.random())) for i in range(500)]
    want: dict = {}
    for k, _, x in data:
        want[k] = 0.7 * want.get(k, 0.0) + 0.3 * x
    d = spark.createDataFrame(data, "k string, i long, x double").repartition(4)
    assert {r["k"]: r["value"] for r in D.smoothed(d, "k", ["i"], "x", partitions=parts).collect()} == pytest.approx(want)


def test_engine_dissolves_a_saturated_pair(spark):
    rows = [("u", i, ["a", "b"][i % 2], "x", "y", float(i), 0.5) for i in range(6)] + [("u", 6, "c", "symmetry", "destructive", 6.0, 0.5), ("u", 7, "a", "x", "y", 7.0, 0.5)]
    d = spark.createDataFrame(rows, "user string, i long, concept string, axis string, level string, seconds double, level_score double")
    got = {r["i"]: r for r in D.engine(d, "user", ["i"], {"a": "b", "b": "a"}).collect()}
    before = 1 - 0.7**3
    assert got[5]["value"] == pytest.approx(before) and got[6]["emergence"] == "destructive" and got[6]["value"] == pytest.approx(0.45)
    assert got[7]["value"] == pytest.approx(0.7 * 0.1 * before + 0.3) and got[0]["link_error"] == 0.0
