"""Evaluation items that share passages with each other."""

import numpy as np

from tidemark.llm import leaks
from tidemark.llm.leaks import ItemIndex, cleaned_texts, item_leaks, leaked_spans, placed_tokens, tokens

PASSAGE = (
    "The harbour town kept its ledgers in a stone house above the quay, and every spring the clerks counted the "
    "barrels of salted herring twice before the first ships were allowed to leave for the northern islands."
)
FIRST = f"{PASSAGE} Why did the clerks count the barrels twice each spring?"
SECOND = f"{PASSAGE} Where were the ledgers of the town kept?"
OTHER = "A quite different item about the way glass blowers cool their vessels slowly over several days in sand."


def found(items: list[str], doc: str) -> set[int]:
    return {i for i, *_ in ItemIndex(list(range(len(items))), items, 0.45).held(tokens(doc))}


def test_items_that_share_the_matched_passage():
    assert found([FIRST, SECOND, OTHER], f"Some words before. {FIRST} Some words after.") == {0, 1}


def test_item_inside_a_longer_match_of_another():
    assert found([FIRST, PASSAGE, OTHER], f"Some words before. {FIRST} And after.") == {0, 1}


def test_item_that_is_a_suffix_of_a_longer_match():
    assert found([f"Read this first with care: {PASSAGE}", PASSAGE, OTHER], f"Read this first with care: {PASSAGE} End.") == {0, 1}


def test_short_shared_phrase_is_no_leak():
    assert found([FIRST, OTHER], "The harbour town kept its ledgers in a stone house, a visitor wrote.") == set()


def test_short_item_as_a_whole():
    assert found(["Name the capital city", FIRST], "They asked: name the capital city of it.") == {0}
    assert found(["Name the capital city", FIRST], "They asked to name the capital.") == set()


def test_tokens_with_places():
    text = "A <b>bold</b> word, cut-\n ting İx 語学"
    got, at = placed_tokens(text)
    assert got == tokens(text) and [text[a:b] for a, b in at][:3] == ["A", "bold", "word"]


def test_likely_items_lose_none(monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(words, rng.integers(6, 40))) for _ in range(40)]
    docs = []
    for _ in range(150):
        it = items[rng.integers(40)].split()
        cut = it[: max(1, int(len(it) * rng.random()))]
        docs.append(list(rng.choice(words, 15)) + cut + list(rng.choice(words, 15)))
    ix = ItemIndex(list(range(40)), items, 0.45)
    everything = list(range(40))
    assert [ix.held(d) for d in docs] == [ix.held(d, everything) for d in docs]


def table(spark, docs):
    return spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(
        [(7, FIRST, "x"), (8, OTHER, "x"), (9, None, "x"), (10, "", "x")], "item_id long, text string, coverage string"
    )


def test_tables_and_blocks(spark, monkeypatch):
    docs, items = table(spark, [(1, FIRST), (1, FIRST), (2, None), (3, ""), (4, "nothing here"), (5, "x " * 20000 + OTHER)])
    got = sorted((r.doc_id, r.item_id) for r in item_leaks(docs, items).collect())
    assert got == [(1, 7), (1, 7), (5, 8)]
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 100)
    assert sorted((r.doc_id, r.item_id) for r in item_leaks(docs, items).collect()) == got
    assert item_leaks(docs.limit(0), items).collect() == [] and item_leaks(docs, items.limit(0)).collect() == []


def test_spans_and_cleaned_texts(spark):
    long = "Some words that stay here before it and more of them follow. " * 4
    docs, items = table(spark, [(1, f"{long}{FIRST} The end stays."), (2, FIRST), (3, "nothing")])
    spans = [(r.doc_id, r.item_id, r.start, r.end) for r in leaked_spans(docs, items).collect()]
    assert (1, 7, len(long), len(long) + len(FIRST) - 1) in spans
    got = {r.doc_id: (r.kept, r.text) for r in cleaned_texts(docs, items).collect()}
    assert got == {1: (True, f"{long}? The end stays."), 2: (False, "")}
