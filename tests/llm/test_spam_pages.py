"""Spam pages: features, learned words, and held-out accuracy on pages of known kind."""

import numpy as np
import pytest

from tidemark.llm import spam_pages as S
from tidemark.llm.page_features import FEATURES, common_counts, page_features
from tidemark.llm.trees import fit_bagged, predict

AT = {f: i for i, f in enumerate(FEATURES)}
NOUNS = [f"{a}{b}{c}{d}" for a in ("ka", "te", "mo", "ri", "vu") for b in ("ba", "lu", "so", "ni", "ge") for c in ("po", "fa", "mi", "du") for d in ("", "r", "n", "sh", "ck")]


def prose(rng):
    def one():
        a, b, c = rng.choice(NOUNS, 3)
        return str(rng.choice([f"The {a} was seen by the {b} and it is now in the {c}.", f"A {a} of the {b} is not what the {c} has been.", f"It was the {a} that the {b} had for the {c}."]))

    return " ".join(one() for _ in range(rng.integers(6, 20)))


def spam(rng):
    few = rng.choice(NOUNS, 3)
    kind = rng.integers(3)
    if kind == 0:
        return " ".join(rng.choice(few, 120))
    if kind == 1:
        return "\n".join(f"https://{rng.choice(NOUNS)}.example/{i}" for i in range(40))
    return ", ".join(f"buy {rng.choice(few)} cheap {rng.choice(few)}" for _ in range(40))


def log(rng):
    return "\n".join(f"2024-01-{rng.integers(10, 28)} 12:{rng.integers(10, 59)} {rng.choice(NOUNS)} took {rng.integers(1000)} of {rng.choice(NOUNS)} in {rng.choice(NOUNS)}" for _ in range(20))


def test_features_of_empty_texts_are_zero():
    assert not page_features([None, "", "  ", "\n"], frozenset()).any() and page_features([], frozenset()).shape == (0, len(FEATURES))


def test_features_don_t_depend_on_the_batch():
    rng = np.random.default_rng(1)
    texts = [prose(rng), spam(rng), None, log(rng), "x" * 50_000, "語" * 5000]
    common = frozenset(["the", "of", "is"])
    together = page_features(texts, common)
    alone = np.concatenate([page_features([t], common) for t in texts])
    assert np.allclose(together, alone)


def test_shares():
    f = page_features(["see https://a.example/b", "#one #two #three", "a, a, a, a, a, a"], frozenset(["see"]))
    assert f[0, AT["link_share"]] == pytest.approx(19 / 22) and f[1, AT["tag_share"]] == 1 and f[2, AT["stuffed_share"]] == 1


def test_counts_of_words_once_per_text():
    g, w, n = common_counts(["a a b", "a", None, "語語"], ["x", "x", "x", None])
    got = dict(zip(zip(g, w), n.tolist()))
    assert got[("x", "a")] == 2 and got[("x", "b")] == 1 and got[("x", "")] == 3 and got[("", "語")] == 1 and got[("", "")] == 1


@pytest.fixture(scope="module")
def pages(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        kind = ["prose", "spam", "log"][0 if rng.random() < 0.7 else rng.integers(1, 3)]
        rows.append((i, {"prose": prose, "spam": spam, "log": log}[kind](rng), f"h{i % 5}" if i % 11 else None, "en", kind))
    rows += [(1000, None, "h1", "en", "prose"), (1001, "", None, None, "prose"), (1000, None, "h1", "en", "prose")]
    return spark.createDataFrame(rows, "page long, text string, host string, lang string, p string")


def test_known_pages(pages):
    got = S.page_scores(pages, "page", "text", "host", ["lang"]).collect()
    kind = {r["page"]: r["p"] for r in pages.collect()}
    assert len(got) == 903 and np.mean([(r["probability"] > 0.5) == (kind[r["page"]] == "spam") for r in got]) > 0.98
    assert [r["probability"] for r in got if r["page"] in (1000, 1001)] == [0.0] * 3


def test_many_hosts_give_the_same(pages, monkeypatch):
    few = {(r["page"], round(r["probability"], 9)) for r in S.page_scores(pages, "page", "text", "host", ["lang"]).collect()}
    monkeypatch.setattr(S, "HOSTS_TO_BROADCAST", 0)
    assert {(r["page"], round(r["probability"], 9)) for r in S.page_scores(pages, "page", "text", "host", ["lang"]).collect()} == few


def test_empty_table(pages):
    assert S.page_scores(pages.limit(0), "page", "text", "host", ["lang"]).collect() == []


def test_trees_on_held_out_rows():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 6))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    forest = fit_bagged(x[:1000], y[:1000])
    assert np.mean((predict(forest, x[1000:]) > 0.5) == (y[1000:] > 0)) > 0.95
