"""Evaluation items that leak into documents, found with suffix automata of the items, and their removal.

Items are worked in blocks of bounded size; each block forms one generalised automaton that every task gets, and the
documents are streamed past it whole. Runs of a few tokens, looked up for a whole batch at once, tell which items a
document may hold; every one of these is then matched with it by itself, its maximal matches are chained in order,
small changes inside a chain are bridged, and an item counts as leaked where its chained tokens cover enough of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.automaton import SuffixAutomaton
from tidemark.llm.codepoints import plain_column

#: One token per word; scripts without spaces give one per character.
TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]|[\p{L}\p{M}\p{N}]+")
#: Markup inside words and words cut at a line's end don't part tokens.
MARKUP = regex.compile(r"</?[a-zA-Z][^<>\n]{0,80}>|(?<=\p{Ll})-\n\s*(?=\p{Ll})")
#: Shortest match in words: to be chained right after another, to be chained anywhere, and to make a
#: document and an item a candidate. A character of a script without spaces counts as 0.4 words.
LEAST, ALONE, ANCHOR = 2, 4.0, 5.0
#: Tokens of an item that may be changed or missing between two chained matches and still count as held.
BRIDGE = 2
#: Part of the wished share that must lie in matches as long as an anchor.
FIRM = 0.25
#: Tokens of a run that is looked up. An anchor has as many tokens at least.
RUN = int(ANCHOR)
#: Characters of items in one block: what is broadcast at a time.
BLOCK_CHARS = 20_000_000
#: Documents whose pairs of tokens are looked at together.
DOCS = 256
MIX = np.int64(-7046029254386353131)


def tokens(text: str) -> list[str]:
    """Lower-case tokens of plain text."""
    return TOKEN.findall(MARKUP.sub("", text).lower())


def placed_tokens(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The tokens of plain text with where each begins and ends in it."""
    gone = [(m.start(), m.end()) for m in MARKUP.finditer(text)]
    at: list[int] = []
    low: list[str] = []
    last = 0
    for a, b in [*gone, (len(text), len(text))]:
        for i in range(last, a):
            c = text[i].lower()
            low.append(c)
            at.extend([i] * len(c))
        last = b
    found = list(TOKEN.finditer("".join(low)))
    return [m.group() for m in found], [(at[m.start()], at[m.end() - 1] + 1) for m in found]


def sizes(seq: list[str]) -> np.ndarray:
    """Running size of a token list in words."""
    return np.concatenate([[0.0], np.cumsum([0.4 if len(t) == 1 and t > "⹿" else 1.0 for t in seq])])


def run_hashes(code: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` codes that begin at each place (arithmetic wraps)."""
    n = len(code) - length + 1
    h = np.zeros(max(0, n), np.int64)
    for i in range(length):
        h = (h ^ (code[i : i + n] + 1)) * MIX
        h ^= h >> 31
    return h


class ItemIndex:
    """Automaton, runs and token lists of the items; ``share`` is the part of an item a document must hold.

    An item shorter than an anchor must stand in the document as a whole.
    """

    def __init__(self, ids: list, texts: list[str], share: float):
        self.ids = ids
        self.tokens = [tokens(t) for t in texts]
        self.automaton = SuffixAutomaton(self.tokens)
        self.share = share
        # Items of a state, and the automaton of an item alone: made on first use and kept.
        self._holders: dict[int, frozenset[int]] = {}
        self._alone: dict[int, SuffixAutomaton] = {}
        self.size = np.array([float(sizes(seq)[-1]) for seq in self.tokens])
        # A token weighs its characters, so that coverage is a share of the text.
        self.weight = [np.concatenate([[0], np.cumsum([len(t) for t in seq])]) for seq in self.tokens]
        words = sorted({t for seq in self.tokens for t in seq})
        self.words = pa.array(words, pa.string())
        code = {t: i for i, t in enumerate(words)}
        coded = [np.array([code[t] for t in seq], np.int64) for seq in self.tokens]
        # Runs by hash with the items that hold them; short items are one run of their own length.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = {RUN: [i for i, z in enumerate(self.size) if z >= ANCHOR - 1e-9]}
        self.short = [i for i, z in enumerate(self.size) if 0 < z < ANCHOR - 1e-9]
        for i in self.short:
            lengths.setdefault(-len(coded[i]), []).append(i)
        for length, items in lengths.items():
            pairs = [np.unique(run_hashes(coded[i], abs(length))) for i in items]
            h = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
            item = np.repeat(np.array(items, np.int64), [len(x) for x in pairs])
            order = np.argsort(h, kind="stable")
            keys, start = np.unique(h[order], return_index=True)
            self.runs[length] = keys, np.append(start, len(h)), item[order]

        # Each item token with the number of the pair it begins, for a bound on what may be chained.
        pairs = [c[:-1] * len(words) + c[1:] for c in coded]
        self.pairs = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]))
        none = np.array([len(self.pairs)])
        self.item_pair = np.concatenate([np.append(np.searchsorted(self.pairs, x), none) if len(c) else none[:0] for c, x in zip(coded, pairs)] + [none[:0]])
        self.item_start = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
        self.item_weight = np.concatenate([*(np.diff(w) for w in self.weight), np.zeros(0)])

    def _bounded(self, pair: np.ndarray, code: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Of the (document, item) pairs those whose item could be covered enough: every token that is chained lies in a
        pair of neighbours that the document holds as well, or in a gap of bridged size between such ones."""
        m = len(self.ids)
        both = np.flatnonzero((doc[1:] == doc[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0))
        key = code[both] * len(self.words) + code[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        hit = self.pairs[at] == key if len(self.pairs) else np.zeros(len(at), bool)
        d, at = doc[both[hit]], at[hit]
        kept = []
        for lo in range(0, int(doc[-1]) + 1 if len(doc) else 0, DOCS):
            mine = pair[(pair // m >= lo) & (pair // m < lo + DOCS)]
            if not len(mine):
                continue
            there = np.zeros((DOCS, len(self.pairs) + 1), bool)
            a, b = np.searchsorted(d, [lo, lo + DOCS])
            there[d[a:b] - lo, at[a:b]] = True
            item = mine % m
            many = self.item_start[item + 1] - self.item_start[item]
            first = np.cumsum(many) - many
            pos = np.repeat(self.item_start[item] - first, many) + np.arange(int(many.sum()))
            begun = there[np.repeat(mine // m - lo, many), self.item_pair[pos]]
            pad = np.zeros(BRIDGE, bool)
            covered = begun | np.append(False, begun[:-1])
            wide = np.concatenate([pad, covered, pad])
            n = len(covered)
            left = np.logical_or.reduce([wide[k : k + n] for k in range(BRIDGE)])
            right = np.logical_or.reduce([wide[BRIDGE + 1 + k : BRIDGE + 1 + k + n] for k in range(BRIDGE)])
            weight = self.item_weight[pos]
            most = np.add.reduceat(weight * (covered | (left & right)), first)
            kept.append(mine[most >= self.share * np.add.reduceat(weight, first) - 1e-9])
        return np.concatenate(kept) if kept else pair[:0]

    def likely(self, docs: list[list[str]]) -> list[list[int]]:
        """Items that each document may hold, by the runs they share. None is lost: an item that is held has so much in
        matches of an anchor's length that at least a fifth as many of its runs must stand in the document, and its
        coverage has a bound that is seen from pairs of neighbouring tokens."""
        flat = pa.array([t for d in docs for t in d], pa.string())
        out: list[list[int]] = [[] for _ in docs]
        if not len(flat) or not len(self.words):
            return out
        enc = pc.dictionary_encode(flat)
        known = pc.fill_null(pc.index_in(enc.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = known[enc.indices.to_numpy(zero_copy_only=False)]
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        m = len(self.ids)
        for length, (keys, start, items) in self.runs.items():
            n = abs(length)
            if not len(keys) or len(code) < n:
                continue
            h = run_hashes(code, n)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero((keys[at] == h) & (doc[: len(h)] == doc[n - 1 :]))
            many = start[at[hit] + 1] - start[at[hit]]
            first = np.cumsum(many) - many
            who = items[np.repeat(start[at[hit]] - first, many) + np.arange(int(many.sum()))]
            pair, count = np.unique(np.repeat(doc[hit], many) * m + who, return_counts=True)
            if length > 0:
                pair = self._bounded(pair[n * count >= FIRM * self.share * self.size[pair % m] - 1e-9], code, doc)
            for d, i in zip((pair // m).tolist(), (pair % m).tolist()):
                out[d].append(i)
        return out

    def _items(self, state: int) -> frozenset[int]:
        got = self._holders.get(state)
        if got is None:
            got = self._holders[state] = frozenset(self.automaton.ends(state)[:, 0].tolist())
        return got

    def _own(self, item: int) -> SuffixAutomaton:
        got = self._alone.get(item)
        if got is None:
            got = self._alone[item] = SuffixAutomaton([self.tokens[item]])
        return got

    def _chained(self, item: int, spans: list[tuple[int, int, int, bool]]) -> tuple[float, list[tuple[int, int]]]:
        """Best share of the item in spans (document start, item start, length, whether it may stand alone) in the same
        order in both texts, and the document tokens (from, to) of that chain."""
        w = self.weight[item]
        spans.sort()
        # Chains grow along the document; the best chain that ends at or before an item position is looked up.
        n = len(spans)
        best = [0.0] * n
        before = [-1] * n
        for j in range(n):
            dj, ij, lj, alone = spans[j]
            top = float(w[ij + lj] - w[ij]) if alone else 0.0
            for k in range(j - 1, -1, -1):
                if not best[k]:
                    continue
                dk, ik, lk, _ = spans[k]
                # Overlapping spans are cut where they overlap in either text.
                cut = max(0, dk + lk - dj, ik + lk - ij)
                if ik >= ij or dk >= dj or cut >= lj:
                    continue
                gain = w[ij + lj] - w[ij + cut]
                gap = ij - (ik + lk)
                near = gap <= BRIDGE and dj - (dk + lk) <= 2 * BRIDGE + 1
                if not (near or alone):
                    continue
                if near and gap > 0:
                    gain += w[ij] - w[ik + lk]
                if best[k] + gain > top:
                    top = best[k] + gain
                    before[j] = k
            best[j] = top
        j = max(range(n), key=best.__getitem__)
        share = best[j] / max(1, w[-1])
        held = []
        while j >= 0:
            d, _, size, _ = spans[j]
            if held and held[-1][0] - (d + size) <= 2 * BRIDGE + 1:
                held[-1] = (d, held[-1][1])
            else:
                held.append((d, d + size))
            j = before[j]
        return share, held[::-1]

    def held(self, doc: list[str], likely: list[int] | None = None) -> list[tuple[int, float, list[tuple[int, int]]]]:
        """Items (index, coverage, document tokens from and to) of which ``doc`` holds at least the share."""
        likely = self.likely([doc])[0] if likely is None else likely
        if not likely:
            return []
        run = sizes(doc)
        out = []
        long_ones = [i for i in likely if self.size[i] >= ANCHOR - 1e-9]
        if long_ones:
            # Candidates share a passage as long as an anchor; each is then matched by itself, since a longer
            # match of another item says nothing about how far this one goes.
            near = np.arange(1, len(run)) - (np.searchsorted(run, run[1:] - ANCHOR + 1e-9, "right") - 1)
            near[run[1:] < ANCHOR - 1e-9] = len(run)
            picked: set[int] = set()
            for state in self.automaton.grams(doc, near.tolist()):
                picked |= self._items(state)
            long_ones = [i for i in long_ones if i in picked]
        for item in long_ones:
            own = self._own(item)
            found = [(end, size, state, float(run[end] - run[end - size])) for end, size, state in own.matches(doc, LEAST)]
            # Enough of the item must lie in long matches.
            if sum(words for *_, words in found if words >= ANCHOR - 1e-9) < FIRM * self.share * self.size[item]:
                continue
            spans = [(end - size, int(at) - size, size, words >= ALONE - 1e-9) for end, size, state, words in found for _, at in own.ends(state)]
            c, where = self._chained(item, spans)
            if c >= self.share:
                out.append((item, c, where))
        for item in likely:
            if self.size[item] < ANCHOR - 1e-9:
                seq = self.tokens[item]
                at = [i for i in range(len(doc) - len(seq) + 1) if doc[i : i + len(seq)] == seq]
                if at:
                    out.append((item, 1.0, [(i, i + len(seq)) for i in at]))
        return sorted(out)


#: Indexes that this worker has built, by the broadcast they came with.
_built: dict[int, ItemIndex] = {}


def _index(shared) -> ItemIndex:
    key = shared.value[3]
    if key not in _built:
        _built.clear()
        _built[key] = ItemIndex(*shared.value[:3])
    return _built[key]


def _blocks(docs: DataFrame, items: DataFrame, item_id: str, text: str, share: float) -> list:
    """Broadcasts of the items, block by block: ids, plain texts, share and a number of its own."""
    rows = items.filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text)
    total = rows.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    out = []
    for k in range(n):
        block = rows.filter(F.pmod(F.xxhash64(item_id, text), F.lit(n)) == k).orderBy(item_id, text).collect()
        plain = plain_column(pa.array([r[1] for r in block], pa.string()), words=False).to_pylist()
        out.append(docs.sparkSession.sparkContext.broadcast(([r[0] for r in block], plain, share, hash((k, n, tuple(plain), tuple(str(r[0]) for r in block), share)))))
    return out


def item_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", share: float = 0.45
) -> DataFrame:
    """One row (``doc_id``, ``item_id``, coverage) per document that holds half of an item's text or more.

    ``share`` of the text must match as it stands, which leaves a tenth of the half for small changes. Items under
    five words must be held as a whole. Both texts are compared in plain form and lower case. Coverage counts
    characters of the item's tokens in matches that keep their order, with single changed or missing words between
    them. Null and empty texts hold nothing and leak nothing; repeated documents and items each give their rows; an
    empty table gives no row. Narrow in the documents: no shuffle; one pass over them per block of items.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(items.schema[item_id].dataType)
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()

    def task(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = _index(shared)
            for b in batches:
                ids, found = [], []
                seqs = [tokens(t) if t else [] for t in plain_column(b.column(1), words=False).to_pylist()]
                for row, (seq, likely) in enumerate(zip(seqs, ix.likely(seqs))):
                    for item, c, _ in ix.held(seq, likely) if likely else ():
                        ids.append(row)
                        found.append((ix.ids[item], c))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(ids, pa.int64())), pa.array([f[0] for f in found], item_type), pa.array([f[1] for f in found], pa.float64())],
                    names=[doc_id, item_id, "coverage"],
                )

        return run

    parts = [docs.select(doc_id, text).mapInArrow(task(s), f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}, coverage double") for s in _blocks(docs, items, item_id, text, share)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaked_spans(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", share: float = 0.45, least_words: float = ANCHOR
) -> DataFrame:
    """One row (``doc_id``, ``item_id``, start, end) per leaked span of at least ``least_words``: characters of the plain text.

    A span runs over the chained matches of an item and the small changes between them. Rows as for ``item_leaks``.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(items.schema[item_id].dataType)
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()

    def task(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = _index(shared)
            for b in batches:
                rows = []
                texts = plain_column(b.column(1), words=False).to_pylist()
                for row, likely in enumerate(ix.likely([tokens(t) if t else [] for t in texts])):
                    if not likely:
                        continue
                    seq, at = placed_tokens(texts[row])
                    run_ = sizes(seq)
                    for item, _, where in ix.held(seq, likely):
                        floor = min(least_words, float(ix.size[item]))
                        rows += [(row, ix.ids[item], at[i][0], at[j - 1][1]) for i, j in where if run_[j] - run_[i] >= floor - 1e-9]
                cols = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                    names=[doc_id, item_id, "start", "end"],
                )

        return run

    parts = [docs.select(doc_id, text).mapInArrow(task(s), f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}, start long, end long") for s in _blocks(docs, items, item_id, text, share)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cleaned_texts(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", share: float = 0.45, most_coverage: float = 0.8
) -> DataFrame:
    """One row (``doc_id``, removed, kept, text) per document that leaks: its plain text less the leaked spans.

    A document of which spans cover more than ``most_coverage`` is given up as a whole (kept false, empty text).
    ``doc_id`` must name a document. Only leaking documents are joined with their spans, which are few per document.
    """
    from tidemark.llm.plain_text import plain_texts

    spans = leaked_spans(docs, items, doc_id, item_id, text, share)
    by_doc = spans.groupBy(doc_id).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_s"))
    d = plain_texts(docs.select(doc_id, text), doc_id, text).join(by_doc, doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, kept, texts = [], [], []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out, last = [], 0
                for s in found:
                    out.append(t[last : max(last, s["start"])])
                    last = max(last, s["end"])
                left = "".join([*out, t[last:]])
                gone = len(t) - len(left)
                removed.append(gone)
                kept.append(gone <= most_coverage * len(t))
                texts.append(left if kept[-1] else "")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.bool_()), pa.array(texts, pa.string())], names=[doc_id, "removed", "kept", text])

    return d.mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, removed long, kept boolean, `{text}` string")
