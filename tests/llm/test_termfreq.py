"""Radix pieces of a task's terms."""

from collections import Counter

import pyarrow as pa
import pytest

from tidemark.llm import termfreq


def batch(n: int) -> pa.RecordBatch:
    terms = [None if i % 50 == 0 else f"t{i % 97}" for i in range(n)]
    # Every third emission is delivered twice, some rows have no emission.
    rows = [(t, None if i % 41 == 0 else i, i % 5, 1) for i, t in enumerate(terms)]
    rows += [r for r in rows[::3] if r[1] is not None]
    kinds = pa.string(), pa.int64(), pa.int64(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["term", "emission", "total", "records"])


@pytest.mark.parametrize("piece_rows", [termfreq.PIECE_ROWS, 40])
def test_terms_always_go_through_pieces(tmp_path, monkeypatch, piece_rows):
    pieces, aggregate = [], termfreq._aggregate
    monkeypatch.setattr(termfreq, "_aggregate", lambda piece, folder: pieces.append(piece) or aggregate(piece, folder))
    out = pa.Table.from_batches(termfreq._task(str(tmp_path), piece_rows)(iter([batch(3000)]))).to_pylist()
    assert len(pieces) > 10 and all(isinstance(p, str) for p in pieces)
    # With small pieces the next hash bits are used as well.
    assert any("-1-" in p for p in pieces) == (piece_rows == 40)
    wished = Counter(None if i % 50 == 0 else f"t{i % 97}" for i in range(3000))
    assert {r["term"]: r["emissions"] for r in out} == wished and len(out) == len(wished)


def test_no_rows(tmp_path):
    assert list(termfreq._task(str(tmp_path), 40)(iter([]))) == []


def test_terms_whose_first_bits_agree(tmp_path):
    # Many terms are split as deep as their hashes need, one heavy term isn't split for ever.
    heavy = pa.RecordBatch.from_arrays([pa.array(["one"] * 500), pa.array(range(500)), pa.array([1] * 500), pa.array([1] * 500)], names=["term", "emission", "total", "records"])
    many = batch(2000)
    out = pa.Table.from_batches(termfreq._task(str(tmp_path), 3)(iter([heavy, many]))).to_pylist()
    got = {r["term"]: r["emissions"] for r in out}
    wished = Counter(None if i % 50 == 0 else f"t{i % 97}" for i in range(2000))
    # Emissions are numbered anew in each batch, so those below 500 are counted for both.
    assert got["one"] == 500 and {k: v for k, v in got.items() if k != "one"} == wished


def test_writes_only_in_the_given_folder(tmp_path):
    list(termfreq._task(str(tmp_path), 40)(iter([batch(200)])))
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
