"""Text functions against known values and plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.unicode import normalized_any


def ask(spark, make, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_tokens(spark):
    assert ask(spark, T.english_tokens, "Hello World! It's a beautiful day.")[0] == ["Hello", "World", "It's", "a", "beautiful", "day"]
    got = ask(spark, T.cjk_bigrams, "日本語テスト", "愛", "a", "")
    assert got == [["日本", "本語", "語テ", "テス", "スト"], ["愛"], [], []]
    assert ask(spark, T.hybrid_tokens, "x日本語y's", None) == [["x", "日本", "本語", "y's"], None]


@pytest.mark.parametrize("token, wished", [("Apple", "apple"), ("か゛", "か"), ("が", "が"), ("・あ", "あ"), ("ヿ", "コト"), ("゛", None), ("It's", "it's")])
def test_normal_form_of_tokens(spark, token, wished):
    assert ask(spark, T.normalized, token) == [wished]


@pytest.mark.parametrize("token, wished", [("ＡＢＣ", "abc"), ("'twas", "twas"), ("...", None), ("①②③", "123"), ("ｶﾀｶﾅ", "カタカナ"), ("「日本」", "日本"), (None, None), ("", None)])
def test_normal_form_of_any_text(spark, token, wished):
    assert ask(spark, normalized_any, token) == [wished]


def test_both_normal_forms_agree_on_tokens(spark):
    chars = [chr(c) for c in range(0x3041, 0x3100) if unicodedata.category(chr(c)) != "Cn"]
    pairs = [a + b for a in chars[::7] for b in chars[::5]] + [a + m for a in chars for m in "゙゚"] + chars
    assert ask(spark, T.normalized, *pairs) == ask(spark, normalized_any, *pairs)


def test_validity(spark):
    assert ask(spark, T.valid_token, "a", "1", "_", "", None, "語") == [True, True, False, False, False, True]


def test_words(spark):
    texts = ["The 'quick' BROWN fox's den -- ok", "", "naïve  'a'"]
    by_hand = [[w.strip("'") for w in re.sub(r"[^a-z0-9'\s]", " ", t.lower()).split() if w.strip("'")] for t in texts]
    assert ask(spark, T.plain_words, *texts) == by_hand
    assert ask(spark, T.is_noise, "the", "x", "fox") == [True, True, False]


def test_ngrams(spark):
    d = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in d.select(T.ngrams(F.col("w"), 2, 3)).collect()] == [["a b", "b c", "a b c"], [], []]


def test_typos(spark):
    from tidemark.operators.words import typo_candidates

    d = spark.createDataFrame([("helo",), ("love",), ("zzzzzz",), ("ab",), (None,), ("lovee",)], "w string")
    got = {r["w"]: (r["suggestion"], r["distance"], r["confidence"]) for r in typo_candidates(d, "w").collect()}
    assert got["helo"] == ("hello", 1, 0.75) and got["lovee"] == ("love", 1, 0.75) and not {"zzzzzz", "ab", None} & set(got)


def test_unknown_names():
    with pytest.raises(ValueError):
        T.tokenizer("none")
