"""Directions of a table of vectors by plain Python, to compare operators with."""

import numpy as np


def directions(rows: list[tuple]) -> tuple[list[str], np.ndarray]:
    """Ids in order and unit rows of (id, time, map) rows; the latest row of an id holds."""
    last: dict = {}
    for i, at, m in sorted((r for r in rows if r[2]), key=lambda r: (r[0], r[1])):
        last[i] = {k: v for k, v in m.items() if v}
    last = {i: m for i, m in last.items() if m}
    ids = sorted(last)
    dims = {k: n for n, k in enumerate(sorted({k for m in last.values() for k in m}))}
    out = np.zeros((len(ids), len(dims)))
    for r, i in enumerate(ids):
        for k, v in last[i].items():
            out[r, dims[k]] = v
    return ids, out / np.linalg.norm(out, axis=1, keepdims=True)
