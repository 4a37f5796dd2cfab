"""Reweighted voting: latest votes, weights, agreement and empty input."""

import datetime as dt

import numpy as np
import pytest

from tidemark.llm.consensus import STATUSES, Consensus, current_votes

SCHEMA = (
    "vote_id long, aggregate_key string, auditor_id string, status_suggestion string, volatility_estimate double, "
    "needs_human_review boolean, voted_at timestamp, received_at timestamp, item string, extra int"
)
T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    full = [(i, k, a, s, v, r, T0 + dt.timedelta(hours=h), T0 + dt.timedelta(hours=h + d), "clash", 1) for i, (k, a, s, v, r, h, d) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def test_later_votes_replace_and_failed_ones_dont(spark):
    rows = [("k", "a", "Defer ", 0.5, True, 1, 0), ("k", "a", "candidate.", 2.0, None, 2, 0), ("k", "a", None, None, None, 3, 0), (None, "a", "defer", 0.1, True, 1, 0)]
    got = current_votes(frame(spark, rows)).collect()
    assert [(r["item"], r["annotator"], r["status"], r["volatility"]) for r in got] == [("k", "a", "candidate", None)]


def test_no_votes(spark):
    c = Consensus(frame(spark, []))
    assert c.items().collect() == [] and c.annotators().collect() == [] and c.alpha is None


def test_one_vote_each_and_ties(spark):
    c = Consensus(frame(spark, [("k", "a", "defer", 0.2, True, 1, 0), ("k", "b", "candidate", 0.4, False, 1, 0), ("m", "a", "quarantine", None, None, 1, 0)]))
    got = {r["item"]: r for r in c.items().collect()}
    assert got["k"]["annotators"] == 2 and got["m"]["status"] == "quarantine" and got["m"]["agreement"] is None
    assert got["k"]["volatility"] in (0.2, 0.4) and got["m"]["volatility"] is None and got["m"]["review"] is None


@pytest.mark.parametrize("partitions", [1, 7])
def test_good_annotators_win_over_many_careless_ones(spark, partitions):
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 3, 400)
    rows = []
    for i, t in enumerate(truth):
        for a in range(3):
            rows.append((f"k{i:03d}", f"good{a}", STATUSES[t if rng.random() < 0.95 else rng.integers(3)], None, None, 1, 0))
        for a in range(4):
            rows.append((f"k{i:03d}", f"lazy{a}", STATUSES[0], None, None, 1, 0))
    c = Consensus(frame(spark, rows).repartition(partitions))
    got = {r["item"]: r["status"] for r in c.items().collect()}
    assert c.settled and np.mean([got[f"k{i:03d}"] == STATUSES[t] for i, t in enumerate(truth)]) > 0.97
    reliable = {r["annotator"]: r["reliability"] for r in c.annotators().collect()}
    assert min(reliable[f"good{a}"] for a in range(3)) > max(reliable[f"lazy{a}"] for a in range(4))


def test_rounds_that_dont_suffice_are_said(spark):
    rows = [(f"k{i}", f"a{j}", STATUSES[(i + (j > 1)) % 3], None, None, 1, 0) for i in range(30) for j in range(4)]
    assert not Consensus(frame(spark, rows), rounds=1).settled


def test_alpha_by_hand(spark):
    # Two items with two ratings each, one agreeing: four values, a, a, a, b.
    c = Consensus(frame(spark, [("x", "a", "candidate", None, None, 1, 0), ("x", "b", "candidate", None, None, 1, 0), ("y", "a", "candidate", None, None, 1, 0), ("y", "b", "defer", None, None, 1, 0)]))
    observed, expected = 2 / 4, 2 * 3 * 1 / (4 * 3)
    assert c.alpha == pytest.approx(1 - observed / expected)
