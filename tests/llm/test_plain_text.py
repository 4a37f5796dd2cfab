"""Plain forms of single terms and of rows."""

import unicodedata

import pyarrow as pa
import pytest

from tidemark.llm.codepoints import plain_column
from tidemark.llm.plain_text import plain_forms


def plain(*terms):
    return plain_column(pa.array(list(terms), pa.string())).to_pylist()


@pytest.mark.parametrize("term", ["δ-vapa", "Π-MEMAME", "α-helix", "kız", "ışık", "поте", "´", "¨", "日本語", "é", "naïve", ""])
def test_terms_that_are_plain(term):
    assert plain(term) == [term]


@pytest.mark.parametrize(
    "stored, wished",
    [
        ("ｌｅｄｇｅｒ", "ledger"),
        ("café", "café"),
        ("sig​nal", "signal"),
        ("le note", "le note"),
        (" note\t", "note"),
        ("a b c d\te", "a b c d e"),
        ("рlumе", "plume"),
        ("шефошизa", "шефошиза"),
        ("ledger nоtе", "ledger note"),
        ("сосо ledger", "coco ledger"),
        ("НІНI_00FAD3", "HIHI_00FAD3"),
        ("HAVOFE'Τ", "HAVOFE'T"),
        ("00аeb2", "00aeb2"),
        ("ｶﾞ", "ガ"),
        ("한", "한"),
        ("𝗋𝖺𝖻𝗈", "rabo"),
        ("​", ""),
    ],
)
def test_terms_that_are_not(stored, wished):
    assert plain(stored) == [wished] and plain(wished) == [wished]


def test_composition_is_that_of_the_unicode_database():
    terms = [unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x250) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<")]
    assert plain(*terms) == [unicodedata.normalize("NFC", t) for t in terms]


def test_batches_don_t_run_into_each_other():
    assert plain(None, "е", "a", "́", "b", None, "nо") == [None, "е", "a", "́", "b", None, "no"]


def test_rows(spark):
    rows = [(1, "note ", None, "x"), (1, "note ", None, "x"), (2, None, "ﬁn", "x"), (3, "plain", "plain", "x"), (4, "", "​", "x"), (5, "a" * 5000 + "­", "b", "x")]
    df = spark.createDataFrame(rows, "row_id long, token_norm string, top_surface_form string, plain string")
    got = sorted((r.row_id, r.field, r.plain) for r in plain_forms(df, "row_id", ["token_norm", "top_surface_form"]).collect())
    assert got == [(1, "token_norm", "note"), (1, "token_norm", "note"), (2, "top_surface_form", "fin"), (4, "top_surface_form", ""), (5, "token_norm", "a" * 5000)]
    assert plain_forms(df.limit(0), "row_id", ["token_norm"]).collect() == []
