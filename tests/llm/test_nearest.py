"""Pairs of nearly equal direction against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from vectors_by_hand import directions

import __spark_entry__
from tidemark.llm import nearest
from tidemark.llm.nearest import nearest_of, similar_pairs

SMALL = "/root/testdata/sf0.001"


def test_p1_found_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/w4_records.parquet").select("article_id", "computed_at", "resonance_vector").collect()]
    ids, m = directions(rows)
    a, b = np.nonzero(np.triu(m @ m.T >= 0.999, 1))
    wished = {(ids[x], ids[y]) for x, y in zip(a, b)}
    found = [tuple(r) for r in __spark_entry__.queries()["p1_found"](spark, SMALL).collect()]
    assert wished and len(found) == len(set(found)) and set(found) == wished


def test_no_link_is_lost_where_a_vector_has_many_partners(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(20)
    m = base + 0.05 * rng.standard_normal((120, 20))
    rows = [(f"v{i:03d}", 1, {f"d{j}": float(x) for j, x in enumerate(v)}) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "id string, at int, v map<string,double>")
    found = {(r.a, r.b) for r in similar_pairs(df, "id", "v", "at", 0.9).collect()}
    ids, u = directions(rows)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    assert found == {(ids[x], ids[y]) for x, y in zip(a, b)} and len(found) > 5000


@pytest.mark.parametrize("cell", [nearest.CELL, 40])
def test_recall_of_the_nearest(spark, monkeypatch, cell):
    monkeypatch.setattr(nearest, "CELL", cell)
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/../sf0.01/w4_records.parquet").select("article_id", "computed_at", "resonance_vector").collect()]
    df = spark.createDataFrame(rows, "id string, at timestamp, v map<string,double>")
    got: dict = {}
    for r in nearest_of(df, "id", "v", "at", 5).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"], r["cosine"]))
    ids, m = directions(rows)
    at = {i: n for n, i in enumerate(ids)}
    cos = m @ m.T
    hit = total = 0
    for i, near in got.items():
        near.sort()
        others = [at[o] for o in got if o != i]
        fifth = np.sort(cos[at[i], others])[-5]
        hit += sum(c >= fifth - 1e-6 for _, _, c in near)
        total += 5
        assert len(near) == len({o for _, o, _ in near}) <= 5
    assert total > 4000 and hit / total >= 0.9


@pytest.mark.parametrize("cell", [nearest.CELL, 8])
def test_vectors_of_one_direction_are_neighbours_and_ties_go_by_id(spark, monkeypatch, cell):
    monkeypatch.setattr(nearest, "CELL", cell)
    rng = np.random.default_rng(4)
    lone = rng.standard_normal((12, 6))
    m = [*lone, *np.repeat(lone[:3], 2, 0) * 3.5, *np.repeat(lone[3:4], 9, 0) * 0.25]
    # Twenty-four vectors that all have the same cosine with "hub", and two pairs of them with one direction.
    tied = [("hub", {"h": 1.0}), *((f"t{i:02d}", {"h": 1.0, f"s{i % 22}": 1.0}) for i in range(24))]
    rows = [(f"v{i:02d}", 1, {f"d{j}": float(x) for j, x in enumerate(v)}) for i, v in enumerate(m)] + [(i, 1, v) for i, v in tied]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "id string, at int, v map<string,double>")
    ids, u = directions(rows)
    cos = np.round(u @ u.T, 9)
    want = {}
    for i, name in enumerate(ids):
        best = sorted((-cos[i, j], o) for j, o in enumerate(ids) if j != i)[:5]
        want[name] = [(o, pytest.approx(-c, abs=2e-9)) for c, o in best]
    got: dict = {}
    for r in nearest_of(df, "id", "v", "at", 5).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["other"], r["cosine"]))
    assert got == want
    some = nearest_of(df, "id", "v", "at", 5, F.col("id").isin("v03", "v20", "hub")).orderBy("id", "rank").collect()
    assert [(r["id"], r["rank"], r["other"]) for r in some] == [(i, n + 1, want[i][n][0]) for i in ("hub", "v03", "v20") for n in range(5)]
