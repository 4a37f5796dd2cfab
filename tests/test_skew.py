"""Balanced per-key results: heavy keys over many partitions, order, nulls, ties."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.skew import balanced_key_totals, heavy_keys, key_sequences

SCHEMA = "id long, k string, c string, n long, v long, key_field int, place int"


def rows(seed=1, n=3000):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = "hot" if rng.random() < 0.9 else None if rng.random() < 0.1 else f"k{rng.integers(40)}"
        out.append((i, k, f"c{rng.integers(3)}", None if rng.random() < 0.1 else int(rng.integers(9)), None if rng.random() < 0.2 else int(rng.integers(2)), 1, 1))
    return out


def by_hand(data):
    groups = defaultdict(list)
    for i, k, c, n, v, *_ in data:
        groups["k", k].append((i, n, v))
        groups["c", c].append((i, n, v))
    return groups


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_totals(spark, parts):
    data = rows()
    got = {(r["key_field"], r["key_value"]): (r["n_rows"], r["lo"], r["hi"], r["n"]) for r in balanced_key_totals(spark.createDataFrame(data, SCHEMA).repartition(6), ["k", "c"], "id", ["n"], parts).collect()}
    want = {g: (len(x), min(i for i, *_ in x), max(i for i, *_ in x), sum(n or 0 for _, n, _ in x)) for g, x in by_hand(data).items()}
    assert got == want


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_sequences(spark, parts):
    data = rows(2)
    got = {(r["key_field"], r["key_value"]): tuple(r)[2:] for r in key_sequences(spark.createDataFrame(data, SCHEMA).repartition(6), ["k", "c"], "id", "v", parts).collect()}
    for g, x in by_hand(data).items():
        x.sort(key=lambda r: r[0])
        gaps = [b[0] - a[0] for a, b in zip(x, x[1:])]
        assert got[g] == (len(x), x[0][0], x[-1][0], x[0][2], x[-1][2], max(gaps, default=0), sum(a[2] != b[2] for a, b in zip(x, x[1:])))
    assert len(got) == len(by_hand(data))


def test_a_heavy_key_spans_partitions(spark):
    data = spark.createDataFrame(rows(3), SCHEMA).select("k", "id").filter("k is not null")
    spread = data.repartitionByRange(8, "k", "id").filter("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert spread >= 6


def test_heavy_share_and_empty(spark):
    d = spark.createDataFrame([(i, "a" if i < 99 else f"b{i}", None, 1, 1, 1, 1) for i in range(100)], SCHEMA)
    assert sorted(tuple(r) for r in heavy_keys(d, ["k", "c"], "id", 0.5).collect()) == [("k", "a")]
    assert sorted(tuple(r) for r in heavy_keys(d, ["k"], "id", 0.01).collect()) == [("k", "a"), ("k", "b99")]
    assert heavy_keys(d.limit(0), ["k"], "id").collect() == [] and key_sequences(d.limit(0), ["k"], "id", "v").collect() == []


def test_repeated_rows_all_count(spark):
    d = spark.createDataFrame([(1, "a", "c", 2, 0, 1, 1)] * 5, SCHEMA)
    assert [(r["n_rows"], r["n"]) for r in balanced_key_totals(d, ["k"], "id", ["n"]).collect()] == [(5, 10)]
