"""Small bagged decision trees on numpy arrays: fitted on a bounded sample, applied to whole batches."""

from __future__ import annotations

import numpy as np


def _grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, depth: int, leaf: int, tried: int) -> list:
    """Nodes as [feature, cut, left, right, share]; feature -1 marks a leaf."""
    nodes: list = []

    def build(rows: np.ndarray, left_depth: int) -> int:
        at = len(nodes)
        wy, ww = w[rows], w[rows] * y[rows]
        share = float(ww.sum() / wy.sum())
        nodes.append([-1, 0.0, -1, -1, share])
        if left_depth == 0 or len(rows) < 2 * leaf or share in (0.0, 1.0):
            return at
        best = (1e-9, -1, 0.0)
        total, pos = wy.sum(), ww.sum()
        base = pos * (total - pos) / total
        for f in rng.permutation(x.shape[1])[:tried]:
            order = np.argsort(x[rows, f], kind="stable")
            v = x[rows, f][order]
            cw, cp = np.cumsum(wy[order]), np.cumsum(ww[order])
            ok = np.flatnonzero(v[1:] > v[:-1])
            ok = ok[(ok >= leaf - 1) & (ok < len(rows) - leaf)]
            if not len(ok):
                continue
            lw, lp = cw[ok], cp[ok]
            rw, rp = total - lw, pos - lp
            gain = base - lp * (lw - lp) / lw - rp * (rw - rp) / rw
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float((v[ok[k]] + v[ok[k] + 1]) / 2))
        if best[1] < 0:
            return at
        goes = x[rows, best[1]] <= best[2]
        nodes[at][:2] = best[1], best[2]
        nodes[at][2] = build(rows[goes], left_depth - 1)
        nodes[at][3] = build(rows[~goes], left_depth - 1)
        return at

    build(np.arange(len(y)), depth)
    return nodes


def fit_bagged(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 8, leaf: int = 3, seed: int = 7) -> list[np.ndarray]:
    """Trees grown on bootstrap samples; both classes weigh the same. One class alone gives one-leaf trees."""
    rng = np.random.default_rng(seed)
    y = y.astype(float)
    pos = max(1.0, y.sum())
    neg = max(1.0, len(y) - y.sum())
    weight = np.where(y > 0, 0.5 / pos, 0.5 / neg)
    tried = max(1, int(np.ceil(np.sqrt(x.shape[1]) * 1.5)))
    grown = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        grown.append(np.array(_grow(x[rows], y[rows], weight[rows], rng, depth, leaf, tried)))
    return grown


def predict(forest: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean share of the positive class over the trees."""
    total = np.zeros(len(x))
    for nodes in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            f = nodes[at, 0].astype(np.int64)
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            left = x[inner, f[inner]] <= nodes[at[inner], 1]
            at[inner] = np.where(left, nodes[at[inner], 2], nodes[at[inner], 3]).astype(np.int64)
        total += nodes[at, 4]
    return total / len(forest)
