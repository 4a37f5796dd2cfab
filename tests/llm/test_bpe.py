"""Token ids against the public libraries, and exact round trips."""

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.bpe import encode_texts, encoder, vocabulary

TEXTS = ["", " ", "Hello world", "it's  we'll\n\n x", "日本語テスト", "👩‍💻 naïve", "<|endoftext|>", "a" * 3000, "\x00​�", "  lead", "1234567 12.5", "ſ'S"]


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_library(reference, text):
    ids = list(encoder(vocabulary()).encode(text))
    assert ids == reference.encode_ordinary(text) and reference.decode(ids) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(reference, text):
    assert list(encoder(vocabulary()).encode(text)) == reference.encode_ordinary(text)


def test_random_words(reference):
    rng = np.random.default_rng(6)
    for _ in range(200):
        text = "".join(rng.choice(list("abcdeinorst ing'.\n"), rng.integers(1, 80)))
        assert list(encoder(vocabulary()).encode(text)) == reference.encode_ordinary(text)


def test_rows(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hi there", "x"), (3, "hi there", "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] or 0), list(r["ids"])) for r in encode_texts(d, "doc_id", "text").collect())
    hi = list(encoder(vocabulary()).encode("hi there"))
    assert got == [(0, list(encoder(vocabulary()).encode("a"))), (1, []), (2, []), (3, hi), (3, hi)]
    assert encode_texts(d.limit(0), "doc_id", "text").collect() == []
