"""Islands against the components of all links."""

from collections import Counter

import __spark_entry__
import numpy as np
import pytest
from vectors_by_hand import directions

from tidemark.llm import islands as module
from tidemark.llm.islands import Tile, components, island_report, islands, linked, tile_joins
from tidemark.operators.components import least_labels

SMALL = "/root/testdata/sf0.001"


def by_hand(rows: list[tuple], least: float) -> dict[str, str]:
    ids, m = directions(rows)
    links = m @ m.T >= least - 1e-12
    first = list(range(len(ids)))
    for seed in range(len(ids)):
        if first[seed] != seed:
            continue
        todo = [seed]
        while todo:
            for n in np.flatnonzero(links[todo.pop()]):
                if n > seed and first[n] == n:
                    first[n] = seed
                    todo.append(int(n))
    size = Counter(first)
    return {ids[i]: ids[f] for i, f in enumerate(first) if size[f] >= 3}


@pytest.mark.parametrize("block_rows", [64, 2048])
def test_islands_against_all_links(spark, block_rows):
    df = spark.read.parquet(f"{SMALL}/w4_records.parquet")
    rows = [tuple(r) for r in df.select("article_id", "computed_at", "resonance_vector").collect()]
    found = [tuple(r) for r in islands(df, "article_id", "resonance_vector", "computed_at", 0.70, block_rows=block_rows).collect()]
    assert len(found) == len(dict(found)) and dict(found) == by_hand(rows, 0.70) != {}


def test_p2_found_is_registered():
    assert "p2_found" in __spark_entry__.queries()


def test_chain_over_many_labels(spark):
    n = 60
    order = np.random.default_rng(3).permutation(n)
    edges = spark.createDataFrame([(f"n{order[i]:02d}", f"n{order[i + 1]:02d}") for i in range(n - 1)], "u string, v string")
    assert {tuple(r) for r in least_labels(edges).collect()} == {(f"n{i:02d}", "n00") for i in range(1, n)}


def test_report_gives_size_and_members_near_the_mean(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(6):
        base = rng.standard_normal(30)
        rows += [(f"g{g}-{i:02d}", 1, {f"d{j}": float(x) for j, x in enumerate(base + 0.3 * rng.standard_normal(30))}) for i in range(5 + g)]
    rows += [("empty", 1, {}), ("null", 1, None), ("zero", 1, {"d1": 0.0})]
    df = spark.createDataFrame(rows, "id string, at int, v map<string,double>")
    got = {r["first"]: r for r in island_report(df, "id", "v", "at", 0.7).collect()}
    ids, m = directions(rows)
    want = by_hand(rows, 0.7)
    assert {f: r["size"] for f, r in got.items()} == Counter(want.values())
    for f, r in got.items():
        inside = [i for i in want if want[i] == f]
        assert len(r["typical"]) == min(3, len(r["typical"])) >= 1 and set(r["typical"]) <= set(inside)
        if r["cells"] == 1:
            mean = sum(m[ids.index(i)] for i in inside)
            assert list(r["typical"]) == sorted(inside, key=lambda i: (-round(float(m[ids.index(i)] @ mean), 9), i))[:3]
    assert island_report(df.limit(0), "id", "v", "at", 0.7).collect() == []


def _tile(m: np.ndarray, sizes: list[int], least: float) -> Tile:
    blocks = []
    for x in np.split(m, np.cumsum(sizes)[:-1]):
        r, d = np.nonzero(x)
        blocks.append((components(linked(x, x, least)), np.bincount(r, minlength=len(x)), d.astype(np.int16), x[r, d]))
    return Tile(blocks, m.shape[1], least)


@pytest.mark.parametrize("least", [0.3, 0.7, 0.9])
def test_bounds_save_work_and_lose_no_link(monkeypatch, least):
    rng = np.random.default_rng(21)
    noise = rng.standard_normal((900, 240)) * (rng.random((900, 240)) < 0.12)
    base = rng.standard_normal((30, 240)) * (rng.random((30, 240)) < 0.12)
    # Islands of three to a hundred rows, two chains whose ends are far apart, and links at the bound itself.
    near = [b + s * rng.standard_normal((n, 240)) * (rng.random((n, 240)) < 0.1) for b, n, s in zip(base, [3, 5, 9, 40, 100] * 6, [0.2, 0.5, 1.0] * 10)]
    turn = np.linspace(0, 3, 40)[:, None]
    chains = [np.cos(turn) * np.eye(240)[i] + np.sin(turn) * np.eye(240)[i + 1] for i in (7, 90)]
    edge = np.eye(240)[[200, 201]] @ np.eye(240) + 0.0
    edge[1, 200], edge[1, 201] = least, np.sqrt(1 - least * least)
    m = np.concatenate([noise, *near, *chains, edge])
    m = m[rng.permutation(len(m))]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    looked: list[int] = []
    verified = module._verified
    monkeypatch.setattr(module, "_verified", lambda a, r, *rest: looked.append(len(r)) or verified(a, r, *rest))
    cut = len(m) // 2
    sides = _tile(m[:cut], [300, cut - 300], least), _tile(m[cut:], [len(m) - cut], least)
    first = np.concatenate([sides[0].comp, sides[1].comp + cut])
    edges = [(i, int(f)) for i, f in enumerate(first)]
    for a, b, p, q in ((0, 0, 0, 0), (0, 1, 0, cut), (1, 1, cut, cut)):
        edges += [(x + p, y + q) for x, y in tile_joins(sides[a], sides[b], least)]
    links = m @ m.T >= least - 1e-12
    joined = np.zeros_like(links)
    for x, y in edges:
        joined[x, y] = joined[y, x] = True
        assert x == y or first[x] == first[y] or links[np.ix_(first == x, first == y)].any()
    assert list(components(joined)) == list(components(links))
    if least >= 0.7:
        assert sum(looked) < len(m) ** 2 / 20


def test_islands_are_the_same_with_many_spots(spark, monkeypatch):
    monkeypatch.setattr(module, "SPOT", 16)
    df = spark.read.parquet(f"{SMALL}/w4_records.parquet")
    rows = [tuple(r) for r in df.select("article_id", "computed_at", "resonance_vector").collect()]
    assert dict(tuple(r) for r in islands(df, "article_id", "resonance_vector", "computed_at", 0.70, block_rows=40).collect()) == by_hand(rows, 0.70)
