"""Islands of vectors that hang together by links of a least cosine, each link verified exactly.

Directions are placed in cells around a bounded sample of pivots and packed into blocks of like size, so
that what is near mostly shares a block. A block's own components are found first. Then every pair of blocks
is compared, tile by tile, but not row by row: a large component is held in balls around its mean, beyond
whose reach nothing is linked to it, and loose rows are held in small groups with the largest and the least
value of every dimension, which bound every product with them. What a bound can't rule out is verified row by
row, so no link is lost. Only links that join two components are kept, and minimum labels are propagated over
these (large and small stars) until nothing changes. The work still grows with the square of the loose rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vectors import Sparse, classes, vector_rows
from tidemark.operators.components import least_labels
from tidemark.session import shared_dir, small, written

#: Pivots of the cells, vectors per block, and the most dimensions (a block is dense over all of them).
PIVOTS, BLOCK, DIMS = 64, 2048, 8192
#: Vectors wished per spot, spots at most, and entries of their pivots at most: blocks are packed by spots, which grow in number with the vectors.
SPOT, SPOTS, ENTRIES = 512, 4096, 2_000_000
#: Tasks that the pairs of tiles are dealt to, tiles wished, and blocks per tile at most.
PIECES, TILES, TILE = 96, 12, 16
#: Components of up to so many rows in a block are loose; loose rows per group; least cosine of a ball's rows to its mean.
LOOSE, GROUP, BALL = 8, 8, 0.8
#: Rows multiplied at once.
ROWS = 1024
#: Products in single precision that are this near to the bound are verified in double precision.
NEAR = 1e-5
EXACT = 1e-12
BLOCKS = "block int, ids array<string>, label array<int>, size array<int>, dim binary, val binary"


def _dense(keys: pa.ChunkedArray, values: pa.ChunkedArray, at: dict[int, int]) -> np.ndarray:
    s = Sparse(keys, values)
    out = np.zeros((len(s), len(at)))
    out[s.row, np.array([at[n] for n in s.names], np.int64)[s.dim]] = s.val
    return out


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the rows of ``a`` and ``b`` (unit vectors, double) have a cosine of at least ``least``."""
    s = a.astype(np.float32) @ b.astype(np.float32).T
    got = s >= least + NEAR
    r, c = np.nonzero((s >= least - NEAR) & ~got)
    got[r, c] = np.einsum("ij,ij->i", a[r], b[c]) >= least - EXACT
    return got


def components(links: np.ndarray) -> np.ndarray:
    """First row of the component of every row of a symmetric matrix of links."""
    label = np.full(len(links), -1, np.int32)
    for seed in range(len(links)):
        if label[seed] >= 0:
            continue
        front = np.array([seed])
        while len(front):
            label[front] = seed
            front = np.flatnonzero(links[front].any(0) & (label < 0))
    return label


def _joins(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join what earlier ones hadn't joined."""
    parent: dict = {}

    def top(v):
        while parent.get(v, v) != v:
            parent[v] = v = parent.get(parent[v], parent[v])
        return v

    out = []
    for a, b in zip(x.tolist(), y.tolist()):
        p, q = top((0, a)), top((1, b))
        if p != q:
            parent[p] = q
            out.append((a, b))
    return out


def _place(pivots: np.ndarray, at: dict[int, int]):
    """Cell (of the first ``PIVOTS``) and spot (of all pivots, those of a cell next to each other) of every vector."""
    coarse = pivots[:PIVOTS]
    order = np.argsort((pivots @ coarse.T).argmax(1), kind="stable")
    fine = pivots[order].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _dense(b.column(1), b.column(2), at)
                cell = (m @ coarse.T).argmax(1).astype(np.int32)
                spot = np.concatenate([(m[i : i + ROWS].astype(np.float32) @ fine.T).argmax(1) for i in range(0, len(m), ROWS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(spot)], names=["rep", "keys", "values", "cell", "spot"])

    return run


def _block(at: dict[int, int], least: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        s = Sparse(t.column("keys"), t.column("values"))
        dim = np.array([at[n] for n in s.names], np.int16)[s.dim]
        m = np.zeros((len(s), len(at)))
        m[s.row, dim] = s.val
        row = [t.column("block")[0].as_py()], [t.column("rep").to_pylist()], [components(linked(m, m, least))], [np.diff(s.offset)], [dim.tobytes()], [s.val.tobytes()]
        kinds = pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()
        return pa.table([pa.array(v, k) for v, k in zip(row, kinds)], names=["block", "ids", "label", "size", "dim", "val"])

    return run


class Tile:
    """Rows of some blocks: dense rows ``m`` in single precision, the component ``comp`` of each, balls and groups.

    ``center``, ``reach``, ``ball_comp`` and ``inside`` (rows) describe the balls; a row whose cosine to a center is
    under the ball's ``reach`` is linked to none of its rows. ``group`` (rows, -1 where fewer) and ``bound`` (largest
    values over 0, then least values under 0) describe the groups of ``loose`` rows.
    """

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], dims: int, least: float):
        """``blocks``: (label, entries per row, dimension and value of each entry) of each block."""
        base = np.cumsum([0, *(len(label) for label, _, _, _ in blocks)])
        self.comp = np.concatenate([label.astype(np.int64) + b for (label, _, _, _), b in zip(blocks, base)])
        self.offset = np.concatenate([[0], np.cumsum(np.concatenate([size for _, size, _, _ in blocks]))])
        self.dim, self.val = np.concatenate([d for _, _, d, _ in blocks]).astype(np.int64), np.concatenate([v for _, _, _, v in blocks])
        self.m = np.zeros((len(self.comp), dims), np.float32)
        self.m[np.repeat(np.arange(len(self.comp)), np.diff(self.offset)), self.dim] = self.val
        self.center, self.reach, self.ball_comp, self.inside = [], [], [], []
        order = np.argsort(self.comp, kind="stable")
        edges = np.flatnonzero(np.diff(self.comp[order], prepend=-1, append=-1))
        loose = [np.zeros(0, np.int64)]
        for i, j in zip(edges, edges[1:]):
            rows = order[i:j]
            while len(rows) > LOOSE:
                mean = self.m[rows].sum(0, dtype=np.float64)
                length = np.linalg.norm(mean)
                cos = self.m[rows] @ (mean / length) if length > 0 else np.full(len(rows), -1.0)
                near = cos >= BALL
                if near.sum() <= LOOSE:
                    break
                self.center.append(mean / length)
                self.reach.append(np.cos(min(np.pi, np.arccos(min(1, least)) + np.arccos(max(-1, min(1, cos[near].min()) - NEAR)))) - NEAR)
                self.ball_comp.append(self.comp[rows[0]])
                self.inside.append(rows[near])
                rows = rows[~near]
            loose.append(rows)
        self.center = np.array(self.center, np.float32).reshape(-1, dims)
        self.reach, self.ball_comp = np.array(self.reach, np.float32), np.array(self.ball_comp, np.int64)
        # Loose rows whose largest entries agree share a group, which makes its bounds narrow.
        self.loose = np.concatenate(loose)
        x = np.abs(self.m[self.loose])
        by, each = [], np.arange(len(x))
        for _ in range(2):
            top = x.argmax(1) if len(x) else each
            by.append(top * 2 + (self.m[self.loose, top] > 0))
            x[each, top] = -1
        self.loose = self.loose[np.lexsort(by[::-1])]
        self.group = np.concatenate([self.loose, np.full(-len(self.loose) % GROUP, -1, np.int64)]).reshape(-1, GROUP)
        x = self.m[np.where(self.group < 0, self.group[:, :1], self.group)]
        self.bound = np.concatenate([np.maximum(x.max(1), 0), np.minimum(x.min(1), 0)], 1) if len(x) else np.zeros((0, 2 * dims), np.float32)

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """``rows`` in double precision."""
        out = np.zeros((len(rows), self.m.shape[1]))
        for i, r in enumerate(rows):
            a, b = self.offset[r], self.offset[r + 1]
            out[i, self.dim[a:b]] = self.val[a:b]
        return out


def _verified(a: Tile, r: np.ndarray, b: Tile, c: np.ndarray, s: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows are linked by their product ``s`` in single precision; what is close to the bound is done again in double."""
    got = s >= np.float32(least + NEAR)
    close = np.flatnonzero((s >= np.float32(least - NEAR)) & ~got)
    for at in (close[i : i + ROWS] for i in range(0, len(close), ROWS)):
        got[at] = np.einsum("ij,ij->i", a.exact(r[at]), b.exact(c[at])) >= least - EXACT
    return got


def _any_link(a: Tile, r: np.ndarray, b: Tile, c: np.ndarray, least: float) -> bool:
    """Whether any of the rows ``r`` is linked to any of the rows ``c``; the work ends with the first link."""
    step = 8
    while len(r):
        now, r, step = r[:step], r[step:], min(ROWS, step * 8)
        s = a.m[now] @ b.m[c].T
        if (s >= np.float32(least + NEAR)).any():
            return True
        i, j = np.nonzero(s >= np.float32(least - NEAR))
        if _verified(a, now[i], b, c[j], s[i, j], least).any():
            return True
    return False


def _loose_links(a: Tile, b: Tile, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows of ``a`` and ``b``, both loose and of different components."""
    for i in range(0, len(a.loose), ROWS) if len(b.loose) else ():
        rows = a.loose[i : i + ROWS]
        x = a.m[rows]
        hit = np.flatnonzero((np.concatenate([np.maximum(x, 0), np.minimum(x, 0)], 1) @ b.bound.T).ravel() >= np.float32(least - NEAR))
        if len(hit) * 50 > len(rows) * len(b.group):
            # So much is near that all products cost less than single ones.
            s = x @ b.m[b.loose].T
            r, c = np.nonzero(s >= np.float32(least - NEAR))
            s, r, c = s[r, c], rows[r], b.loose[c]
            ok = _verified(a, r, b, c, s, least)
            yield r[ok], c[ok]
            continue
        for h in (hit[k : k + 2 * ROWS] for k in range(0, len(hit), 2 * ROWS)):
            r, c = np.repeat(rows[h // len(b.group)], GROUP), b.group[h % len(b.group)].ravel()
            use = c >= 0
            r, c = r[use], c[use]
            ok = _verified(a, r, b, c, np.einsum("ij,ij->i", a.m[r], b.m[c]), least)
            yield r[ok], c[ok]


def _ball_links(a: Tile, rows: np.ndarray, b: Tile, least: float, same: bool) -> Iterator[tuple[int, int]]:
    """Components of ``rows`` of ``a`` and of balls of ``b`` that a link joins."""
    near_r, near_b, near_s = [], [], []
    for i in range(0, len(rows), ROWS) if len(b.center) else ():
        s = a.m[rows[i : i + ROWS]] @ b.center.T
        r, c = np.nonzero(s >= b.reach)
        near_r.append(rows[i + r])
        near_b.append(c)
        near_s.append(s[r, c])
    if not near_r:
        return
    r, c, s = np.concatenate(near_r), np.concatenate(near_b), np.concatenate(near_s)
    if same:
        use = a.comp[r] != b.ball_comp[c]
        r, c, s = r[use], c[use], s[use]
    order = np.lexsort((-s, c, a.comp[r]))
    r, c = r[order], c[order]
    edges = np.flatnonzero((np.diff(a.comp[r], prepend=-1, append=-1) != 0) | (np.diff(c, prepend=-1, append=-1) != 0))
    seen = set()
    for i, j in zip(edges, edges[1:]):
        x, y = int(a.comp[r[i]]), int(b.ball_comp[c[i]])
        if (x, y) not in seen and _any_link(a, r[i:j], b, b.inside[c[i]], least):
            seen.add((x, y))
            yield x, y


def tile_joins(a: Tile, b: Tile, least: float) -> list[tuple[int, int]]:
    """Links (component of ``a``, component of ``b``) that join what is linked between two tiles, or within one."""
    x, y, same = [], [], a is b
    for r, c in _loose_links(a, b, least):
        x.append(a.comp[r])
        y.append(b.comp[c])
    pairs = list(_ball_links(a, np.arange(len(a.comp)), b, least, same))
    pairs += [(u, v) for v, u in _ball_links(b, b.loose, a, least, same)]
    x = np.concatenate([*x, np.array([u for u, _ in pairs], np.int64)])
    y = np.concatenate([*y, np.array([v for _, v in pairs], np.int64)])
    both = np.unique((x * len(b.comp) + y)[x != y] if same else x * len(b.comp) + y)
    return _joins(both // len(b.comp), both % len(b.comp))


def _across(path: str, dims: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(path) if "://" in path else (None, path)

        def load(n: int) -> tuple[pa.Array, Tile]:
            t = ds.dataset(f"{root}/at={n}", filesystem=fs, format="parquet").to_table(columns=["ids", "label", "size", "dim", "val"])
            rows = zip(*(t.column(c) for c in ("label", "size", "dim", "val")))
            blocks = [(p.values.to_numpy(), q.values.to_numpy(), np.frombuffer(d.as_py(), np.int16), np.frombuffer(v.as_py(), np.float64)) for p, q, d, v in rows]
            return t.column("ids").combine_chunks().flatten(), Tile(blocks, dims, least)

        held: tuple = (None, None)
        for batch in batches:
            u, v = [], []
            for n in batch.column(0).to_pylist():
                # The n-th pair of the order (0, 0), (1, 0), (1, 1), (2, 0), ...
                i = (isqrt(8 * n + 1) - 1) // 2
                j = n - i * (i + 1) // 2
                if held[0] != i:
                    held = (i, load(i))
                (ids, a), (others, b) = held[1], held[1] if i == j else load(j)
                for x, y in tile_joins(a, b, least):
                    u.append(ids[x].as_py())
                    v.append(others[y].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string())], names=["u", "v"])

    return run


def islands(df: DataFrame, id_col: str, map_col: str, order_col: str, least_cosine: float, least_size: int = 3, block_rows: int = BLOCK) -> DataFrame:
    """One row (id, first) per id in an island, with the island's smallest id.

    Ids are linked if their vectors have a cosine of at least ``least_cosine`` (over 0); an island is at least
    ``least_size`` ids that hang together. Of several rows of an id the latest counts. Null and empty vectors
    belong to none; an empty table gives no row. More than ``DIMS`` keys are an error.
    """
    return _islands(df, id_col, map_col, order_col, least_cosine, least_size, block_rows)[0]


def island_report(
    df: DataFrame, id_col: str, map_col: str, order_col: str, least_cosine: float, least_size: int = 3, typical: int = 3, block_rows: int = BLOCK
) -> DataFrame:
    """One row (first, size, cells, typical) per island: its size, the cells it lies in, its most typical members.

    These are the members of the island's densest cell (the first cell on a tie) whose direction is nearest to the
    island's mean direction; ties go by id. Rows, nulls and empty tables as for ``islands``.
    """
    found, placed, member = _islands(df, id_col, map_col, order_col, least_cosine, least_size, block_rows)
    m = found.join(member, "id").join(placed.select("rep", "cell", "keys", "values"), "rep")
    per_cell = m.groupBy("first", "cell").agg(F.count(F.lit(1)).alias("n"))
    dense = per_cell.groupBy("first").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("cells"), F.min_by("cell", F.struct(-F.col("n"), F.col("cell"))).alias("cell"))
    entry = m.select("first", F.explode(F.arrays_zip("keys", "values")).alias("e")).select("first", F.col("e.keys").alias("k"), F.col("e.values").alias("v"))
    mean = entry.groupBy("first", "k").agg(F.sum("v").alias("mean"))
    near = m.join(dense, ["first", "cell"]).select("first", "id", F.explode(F.arrays_zip("keys", "values")).alias("e"))
    near = near.select("first", "id", F.col("e.keys").alias("k"), F.col("e.values").alias("v")).join(mean, ["first", "k"])
    score = near.groupBy("first", "id").agg(F.round(F.sum(F.col("v") * F.col("mean")), 9).alias("s"))
    best = F.row_number().over(Window.partitionBy("first").orderBy(F.desc("s"), "id"))
    top = score.withColumn("r", best).filter(F.col("r") <= typical).groupBy("first").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("t"))
    return dense.join(top, "first").select("first", "size", "cells", F.col("t.id").alias("typical"))


def _islands(df: DataFrame, id_col: str, map_col: str, order_col: str, least_cosine: float, least_size: int, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``islands``, the directions with their cells, and which direction each id has."""
    spark = df.sparkSession
    reps, member = classes(written(vector_rows(df, id_col, map_col, order_col), "vectors"))
    reps, member = written(reps, "reps"), written(member, "members")
    names = small(reps.select(F.explode("keys").alias("k")).distinct(), DIMS)
    if names is None:
        raise ValueError(f"more than {DIMS} dimensions")
    at = {k: n for n, k in enumerate(sorted(r[0] for r in names))}
    pivots = max(PIVOTS, min(reps.count() // SPOT, SPOTS, ENTRIES // max(1, len(at))))
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(pivots).toArrow()
    if not sample.num_rows:
        none = member.select("id", F.col("rep").alias("first")).limit(0)
        return none, reps.select("rep", "keys", "values", F.lit(0).alias("cell")), member
    placed = reps.select("rep", "keys", "values").mapInArrow(_place(_dense(sample.column("keys"), sample.column("values"), at), at), "rep string, keys array<bigint>, values array<double>, cell int, spot int")
    placed = written(placed, "placed")
    # Spots in order are packed into blocks; one that outgrows a block is cut by hash.
    rows, count, room = [], 0, block_rows
    for spot, n in sorted(placed.groupBy("spot").count().collect()):
        pieces = -(-n // block_rows)
        if pieces > 1 or n > room:
            count, room = count + (room < block_rows), block_rows
        rows.append((spot, count, pieces))
        count, room = (count + pieces, block_rows) if pieces > 1 else (count, room - n)
    count += room < block_rows
    packed = F.broadcast(spark.createDataFrame(rows, "spot int, base int, pieces int"))
    block = (F.col("base") + F.pmod(F.xxhash64("rep"), F.col("pieces"))).cast("int")
    blocks = placed.join(packed, "spot").select("rep", "keys", "values", block.alias("block")).groupBy("block").applyInArrow(_block(at, least_cosine), BLOCKS)
    path = f"{shared_dir(spark)}/tidemark/blocks-{uuid.uuid4().hex}"
    per = min(TILE, -(-count // TILES))
    blocks.withColumn("at", F.floor(F.col("block") / per)).write.partitionBy("at").parquet(path)
    inside = spark.read.schema(BLOCKS).parquet(path).select("ids", F.posexplode("label").alias("row", "first"))
    edges = inside.select(F.expr("ids[row]").alias("u"), F.expr("ids[first]").alias("v"))
    if count > 1:
        tiles = -(-count // per)
        pairs = tiles * (tiles + 1) // 2
        numbers = spark.range(0, pairs, 1, min(pairs, PIECES))
        edges = edges.unionByName(numbers.mapInArrow(_across(path, len(at), least_cosine), "u string, v string"))
    found = member.join(least_labels(edges).withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("label", "rep").alias("first"))
    found = written(found, "islands")
    large = found.groupBy("first").count().filter(F.col("count") >= least_size).select("first")
    return found.join(large, "first").select("id", "first"), placed, member
