"""The most similar vectors of every vector through low-dimensional stable projections and kd-trees.

Unit vectors are projected to a few dimensions by 2-stable (normal) coefficients. A kd-tree over a bounded
sample of projected points cuts the space into cells of like size; each vector lives in its own cell and
visits, as a query, the other cells its search ball can touch. Inside a cell the vectors form a kd-tree
whose buckets are met in the order of their projected distance; what is met is verified by exact cosine,
and a query stops as soon as a chi-square test says that nothing nearer than its k-th neighbour is likely
to lie beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chi2 import chi2_quantile
from tidemark.llm.vectors import Sparse, classes, vector_rows, with_projection
from tidemark.session import written

#: Projected dimensions (even), the seed of the coefficients, vectors per bucket and wished per cell.
WIDTH, SEED, BUCKET, CELL = 8, 11, 32, 4000
#: Projected points that the cells are cut by (the only sample; every vector is indexed).
SAMPLE = 50_000
#: Decimal places by which the nearest are ranked (what is equal in these is a tie).
PLACES = 9
PAIR = "rep string, other string, cosine double"


def cut_cells(points: np.ndarray, cells: int) -> list[tuple]:
    """kd-tree over sampled points as nodes (axis, cut, left, right), leaves as (-1, cell, -1, -1)."""
    nodes: list = []
    count = 0

    def build(p: np.ndarray, parts: int) -> int:
        nonlocal count
        at = len(nodes)
        nodes.append((-1, count, -1, -1))
        axis = int(np.argmax(p.max(0) - p.min(0))) if len(p) else 0
        if parts <= 1 or len(p) < 2 or p[:, axis].max() <= p[:, axis].min():
            count += 1
            return at
        cut = float(np.median(p[:, axis]))
        if cut >= p[:, axis].max():
            cut = float((p[:, axis].min() + p[:, axis].max()) / 2)
        low = p[:, axis] <= cut
        a = build(p[low], parts // 2)
        b = build(p[~low], parts - parts // 2)
        nodes[at] = (axis, cut, a, b)
        return at

    build(points, cells)
    return nodes


def cells_within(nodes: list[tuple], p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row, cell, home) of points and the cells that their ball of ``radius`` can touch."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def walk(at: int, rows: np.ndarray, home: np.ndarray, gap2: np.ndarray, near: np.ndarray) -> None:
        if not len(rows):
            return
        axis, cut, a, b = nodes[at]
        if axis < 0:
            out.append((rows, cut, home))
            return
        d = p[rows, axis] - cut
        for child, mine in ((a, d <= 0), (b, d > 0)):
            side = near.copy()
            side[:, axis] = np.where(mine, near[:, axis], np.maximum(near[:, axis], d * d))
            ok = side.sum(1) <= radius * radius
            walk(child, rows[ok], (home & mine)[ok], gap2[ok], side[ok])

    n = len(p)
    walk(0, np.arange(n), np.ones(n, bool), np.zeros(n), np.zeros_like(p))
    return (
        np.concatenate([r for r, _, _ in out]),
        np.concatenate([np.full(len(r), c) for r, c, _ in out]),
        np.concatenate([h for _, _, h in out]),
    )


def _buckets(p: np.ndarray) -> list[np.ndarray]:
    """Rows of a kd-tree's buckets, cut at the median of the widest axis."""
    done, stack = [], [np.arange(len(p))]
    while stack:
        rows = stack.pop()
        if len(rows) <= BUCKET:
            done.append(rows)
            continue
        axis = int(np.argmax(np.ptp(p[rows], axis=0)))
        order = np.argsort(p[rows, axis], kind="stable")
        half = len(rows) // 2
        stack += [rows[order[:half]], rows[order[half:]]]
    return done


def search_cell(s: Sparse, p: np.ndarray, data: np.ndarray, query: np.ndarray, k: int | None, reach2: float, confidence: float):
    """k most similar data rows (all within reach if None) of every query row, as (query, data, cosine) arrays.

    ``reach2`` bounds the squared distance of wished neighbours. Queries are worked bucket by bucket: the
    data buckets are met in the order of their projected distance to the query bucket, until the test
    holds for every query of the bucket. With ``k`` cosines are rounded to ``PLACES``, ties go by row.
    """
    bound = chi2_quantile(confidence, p.shape[1])
    trees = [data[b] for b in _buckets(p[data])]
    lo = np.array([p[b].min(0) for b in trees])
    hi = np.array([p[b].max(0) for b in trees])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for qb in (query[b] for b in _buckets(p[query])):
        qlo, qhi = p[qb].min(0), p[qb].max(0)
        gap = np.maximum(0, np.maximum(lo - qhi, qlo - hi))
        far = (gap * gap).sum(1)
        order = np.argsort(far, kind="stable")
        base = np.zeros((len(qb), len(s.names)), np.float64)
        for i, r in enumerate(qb):
            a, b = s.offset[r], s.offset[r + 1]
            base[i, s.dim[a:b]] = s.val[a:b]
        top_c = np.full((len(qb), k or 0), -2.0)
        top_i = np.full((len(qb), k or 0), -1, np.int64)
        kth2 = np.full(len(qb), reach2)
        for t in order:
            # Stop: with the wished confidence, whatever lies beyond isn't nearer than the k-th found. Projected
            # squared distances are chi-square multiples of true ones, so the test is one bound on their quotient.
            open_ = far[t] < bound * np.maximum(kth2, 1e-18)
            if not open_.any():
                break
            rows = trees[t]
            # Each pair by itself: projected points too far apart for their distance need no verification.
            d2 = ((p[qb][:, None, :] - p[rows][None, :, :]) ** 2).sum(2)
            likely = (d2 < bound * np.maximum(kth2, 1e-18)[:, None]) & open_[:, None] & (qb[:, None] != rows[None, :])
            if not likely.any():
                continue
            use = likely.any(0)
            rows, likely = rows[use], likely[:, use]
            sizes = s.offset[rows + 1] - s.offset[rows]
            at = np.repeat(s.offset[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            cos = np.add.reduceat(base[:, s.dim[at]] * s.val[at], starts, axis=1)
            cos = np.where(likely, cos, -2.0)
            if k is None:
                q, j = np.nonzero(likely & (2 - 2 * cos <= reach2 + 1e-9))
                out.append((qb[q], rows[j], cos[q, j]))
                continue
            all_c = np.concatenate([top_c, np.round(cos, PLACES)], 1)
            all_i = np.concatenate([top_i, np.broadcast_to(rows, cos.shape)], 1)
            best = np.lexsort((all_i, -all_c), axis=1)[:, :k]
            top_c, top_i = np.take_along_axis(all_c, best, 1), np.take_along_axis(all_i, best, 1)
            kth2 = np.minimum(reach2, np.where(top_c[:, -1] > -2, 2 - 2 * top_c[:, -1] + 2 * 10.0**-PLACES, reach2))
        got = (top_i >= 0) & (2 - 2 * top_c <= reach2 + 1e-9)
        q, j = np.nonzero(got)
        out.append((qb[q], top_i[q, j], top_c[q, j]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _route(nodes: list[tuple], radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = b.column(3).flatten().to_numpy().reshape(b.num_rows, -1)
            asks = b.column(4).to_numpy(zero_copy_only=False)
            row, cell, home = cells_within(nodes, p, radius)
            keep = home | asks[row]
            row, cell, home = row[keep], cell[keep], home[keep]
            out = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int32)), pa.array(home)], names=["rep", "keys", "values", "p", "asks", "cell", "home"])

    return run


def _search(k: int | None, reach2: float, confidence: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The partition is sorted by cell; a cell is worked as soon as the next one begins.
        held: list[pa.Table] = []

        def work(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            s = Sparse(t.column("keys"), t.column("values"))
            p = t.column("p").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            data = np.flatnonzero(t.column("home").to_numpy())
            query = np.flatnonzero(t.column("asks").to_numpy())
            q, d, c = search_cell(s, p, data, query, k, reach2, confidence)
            ids = t.column("rep").combine_chunks()
            return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), ids.take(pa.array(d)), pa.array(c)], names=["rep", "other", "cosine"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            cell = t.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
            for i, j in zip(edges, edges[1:]):
                if held and held[0].column("cell")[0].as_py() != int(cell[i]):
                    yield work(pa.concat_tables(held))
                    held = []
                held.append(t.slice(i, j - i))
        if held:
            yield work(pa.concat_tables(held))

    return run


def most_similar(
    reps: DataFrame, k: int | None, least_cosine: float = -1.0, confidence: float = 0.99999, asking: DataFrame | None = None
) -> DataFrame:
    """Up to ``k`` most similar other vectors (all if None) of every vector (or of those whose rep is ``asking``): rep, other, cosine.

    ``reps``: rep, keys, values (unit vectors, one per direction). With ``k`` cosines are rounded to ``PLACES``
    and ties go by ``other``. Only neighbours of at least ``least_cosine`` are wished; a pair is missed with a probability of at most 1 - ``confidence``.
    Without a bound on the cosine a query may visit every cell, as any vector may be its neighbour.
    """
    spark = reps.sparkSession
    points = with_projection(reps, WIDTH, SEED)
    if asking is None:
        points = points.withColumn("asks", F.lit(True))
    else:
        points = points.join(asking.select("rep", F.lit(True).alias("a")), "rep", "left").select("rep", "keys", "values", "p", F.col("a").isNotNull().alias("asks"))
    points = written(points, "points")
    n = points.count()
    reach2 = 2 - 2 * least_cosine
    radius = float(np.sqrt(reach2 * chi2_quantile(confidence, WIDTH)))
    share = min(1.0, SAMPLE / max(1, n))
    sample = points.filter(F.abs(F.xxhash64("rep") % 1_000_003) < share * 1_000_003).select("p").limit(2 * SAMPLE).collect()
    cells = max(1, min(len(sample) // 8, -(-n // CELL)))
    nodes = cut_cells(np.array([r[0] for r in sample]).reshape(-1, WIDTH), cells)
    routed = points.mapInArrow(_route(nodes, radius), "rep string, keys array<bigint>, values array<double>, p array<double>, asks boolean, cell int, home boolean")
    parts = max(1, min(cells, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = routed.repartition(parts, "cell").sortWithinPartitions("cell", "rep").mapInArrow(_search(k, reach2, confidence), PAIR)
    if cells == 1 or k is None:
        return found
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "other"))), 1, k)
    return found.groupBy("rep").agg(best.alias("b")).select("rep", F.explode("b").alias("b")).select("rep", "b.other", (-F.col("b.c")).alias("cosine"))


def similar_pairs(df: DataFrame, id_col: str, map_col: str, order_col: str, least_cosine: float) -> DataFrame:
    """Pairs (a, b, cosine) of different ids, a < b, whose vectors have at least ``least_cosine``.

    Vectors of equal direction form a class that is searched once; its members pair with each other and with
    the members of all classes near it, however many. Null and empty vectors have no pair; an empty table gives
    no row.
    """
    reps, member = classes(written(vector_rows(df, id_col, map_col, order_col), "vectors"))
    reps, member = written(reps, "reps"), written(member, "members")
    near = most_similar(reps, None, least_cosine).filter(F.col("cosine") >= least_cosine - 1e-12)
    links = near.select(F.least("rep", "other").alias("x"), F.greatest("rep", "other").alias("y"), "cosine").groupBy("x", "y").agg(F.max("cosine").alias("cosine"))
    a = member.select(F.col("rep").alias("x"), F.col("id").alias("a"))
    b = member.select(F.col("rep").alias("y"), F.col("id").alias("b"))
    across = links.join(a, "x").join(b, "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")
    within = a.join(b, (F.col("x") == F.col("y")) & (F.col("a") < F.col("b"))).select("a", "b", F.lit(1.0).alias("cosine"))
    return across.unionByName(within)


def nearest_of(df: DataFrame, id_col: str, map_col: str, order_col: str, k: int, asked: F.Column | None = None, confidence: float = 0.99999) -> DataFrame:
    """The ``k`` most similar other vectors of each id that is ``asked`` (all if None): id, rank, other, cosine.

    Vectors of one direction form a class that is searched once; its members are neighbours of each other at a cosine
    of 1, and each is a neighbour of other vectors by itself. ``asked`` is an expression of the column ``id``. Every
    vector is searched; cosines equal in ``PLACES`` are ties and go by id. Null and empty vectors are no neighbours and
    have none; an empty table gives no row.
    """
    reps, member = classes(written(vector_rows(df, id_col, map_col, order_col), "vectors"))
    reps, member = written(reps, "reps"), written(member, "members")
    wished = member if asked is None else written(member.filter(asked), "asked")
    asking = wished.select("rep").distinct()
    near = most_similar(reps, k, confidence=confidence, asking=None if asked is None else asking)
    near = near.select("rep", "cosine", F.col("other").alias("of")).unionByName(asking.select("rep", F.lit(1.0).alias("cosine"), F.col("rep").alias("of")))
    # The first k + 1 ids of a class, and of all that is near a class, are enough for each of its members.
    first = member.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("n") <= k + 1)
    each = near.join(first.select(F.col("rep").alias("of"), F.col("id").alias("other")), "of").select("rep", (-F.col("cosine")).alias("c"), "other")
    each = each.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("c", "other"))).filter(F.col("n") <= k + 1)
    best = each.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "other"))).alias("b"))
    ranked = wished.join(best, "rep").select("id", F.posexplode(F.slice(F.filter("b", lambda x: x["other"] != F.col("id")), 1, k)).alias("n", "v"))
    return ranked.select("id", (F.col("n") + 1).alias("rank"), F.col("v.other").alias("other"), (-F.col("v.c")).alias("cosine"))
