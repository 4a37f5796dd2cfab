"""Segmenters against plain Python over texts of many kinds."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions.spans import ABBREVIATIONS
from tidemark.operators import segment as G


def trimmed(text, a, b, least):
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return [(a, b)] if b - a >= max(1, least) else []


def sentences(text, least=3):
    out, start = [], 0
    for m in re.finditer(r"[.!?](?=\s+[A-Z]|\s*\Z)", text):
        p = m.start()
        lo = p - 1
        while lo > 0 and text[lo - 1].isalpha():
            lo -= 1
        word = text[max(lo, 0) : p].lower()
        if p and (word in ABBREVIATIONS or (len(word) <= 2 and lo > 0 and text[lo - 1] == ".")):
            continue
        out += trimmed(text, start, m.end(), least)
        start = m.end()
    return out + trimmed(text, start, len(text), least)


def paragraphs(text, least=10):
    out, start = [], 0
    for m in re.finditer(r"\n\s*\n", text):
        out += trimmed(text, start, m.start(), least)
        start = m.end()
    return out + trimmed(text, start, len(text), least)


def spans(spark, make, texts):
    d = make(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").collect()
    got = {i: [] for i in range(len(texts))}
    for r in d:
        got[r["i"]].append((r["start"], r["end"]))
        assert r["segment"] == texts[r["i"]][r["start"] : r["end"]]
    return [sorted(v) for v in got.values()]


TEXTS = [
    "Dr. Who met Mr. Smith. It was 5 p.m. Then they left! Really? Yes",
    "The U.S. Navy came. e.g. This one. No.A stays.",
    "Wait... What? ...",
    "a b.  Ärger bleibt. Ende",
    "Zwei Sätze. Und Drei.",
    " \n ",
    "",
    "One.\n\nTwo is a longer paragraph.\n \t\nThree is another one. With two sentences.\n\n\n",
    "日本語。テスト. Next",
    "x" * 20000 + ". Y",
    ".A. B",
]


def test_sentences(spark):
    assert spans(spark, G.sentences, TEXTS) == [sentences(t) for t in TEXTS]


def test_paragraphs(spark):
    assert spans(spark, G.paragraphs, TEXTS) == [paragraphs(t) for t in TEXTS]


def test_sentences_in_paragraphs(spark):
    want = []
    for t in TEXTS:
        ps = paragraphs(t)
        want.append(sorted((a + x, a + y) for a, b in ps for x, y in sentences(t[a:b])) if ps else sentences(t))
    assert spans(spark, G.sentences_in_paragraphs, TEXTS) == want


def test_random_texts(spark):
    rng = np.random.default_rng(5)
    parts = [".", "!", "? ", " ", "\n", "\n\n", "A", "bc", "mr", "St", "e.g", "1", "é", "語", "　"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(300)]
    assert spans(spark, G.sentences, texts) == [sentences(t) for t in texts]
    assert spans(spark, G.paragraphs, texts) == [paragraphs(t) for t in texts]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=6))
def test_running_sums(sizes):
    import pyarrow as pa

    from tidemark.functions import spans as S

    f = S._running.func
    got = f(pa.array([sizes, None, sizes], pa.list_(pa.int32()))).to_pylist()
    want = [sum(sizes[:i]) for i in range(len(sizes))]
    assert got == [want, [], want]


def test_nulls_have_no_segment(spark):
    d = spark.createDataFrame([(1, None)], "i int, t string")
    assert G.sentences(d, "t").collect() == [] and G.paragraphs(d, "t").collect() == [] and G.sentences_in_paragraphs(d, "t").collect() == []
