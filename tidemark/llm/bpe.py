"""Byte-level BPE encoding of whole texts in linear time.

The vocabulary is matched with one Aho-Corasick pass per word over its bytes, mapped to Latin-1; from the
longest match at each position the encoder backtracks to shorter prefixes until neighbouring tokens are
compatible, which gives exactly the merges of the greedy rank order. Whether two tokens may stand next to
each other is memoised, and so is the encoding of words already seen.

The compatibility test and the backtracking follow the idea that GitHub published with its ``bpe`` crate (rust-gems
repository, MIT licence).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pre-tokenisation pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers before it starts anew.
WORDS_IN_MEMORY = 200_000
PAIRS_IN_MEMORY = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encoder of one vocabulary file (JSON with ``model.vocab`` and ``model.merges``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        latin = lambda s: "".join(chr(alphabet[c]) for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        # Ranks: bytes first, then merges in their order; ids are looked up at the end.
        words = [chr(b) for b in range(256)] + [latin(a + b) for a, b in merges]
        rank = {w: r for r, w in reversed(list(enumerate(words)))}
        self.words, self.rank = words, rank
        back = {v: k for k, v in alphabet.items()}
        self.ids = [vocab["".join(back[ord(c)] for c in w)] for w in words]
        self.parts = [(r, r) for r in range(256)] + [(rank[latin(a)], rank[latin(b)]) for a, b in merges]
        self.merged = {self.parts[r]: r for r in range(256, len(words))}
        self.trie = ahocorasick.Automaton()
        for w, r in rank.items():
            self.trie.add_word(w, r)
        self.trie.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.seen: dict[str, tuple[int, ...]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging in rank order leaves the border between tokens ``a`` and ``b`` standing."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is not None:
            return known
        parts, merged, bound, good = self.parts, self.merged, len(self.words) + 1, True
        while True:
            m = merged.get((a, b))
            if m is not None and m < bound:
                good = False
                break
            # Undo the later of the two merges and look at the border one step earlier.
            if a > b:
                bound, a = a, parts[a][1]
                if a != bound:
                    continue
                bound, b = b + 1, parts[b][0]
                if b + 1 == bound:
                    break
            else:
                bound, b = b + 1, parts[b][0]
                if b + 1 != bound:
                    continue
                bound, a = a, parts[a][1]
                if a == bound:
                    break
        if len(self.pairs) >= PAIRS_IN_MEMORY:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def prefix(self, r: int) -> int:
        """The longest shorter token that ``r`` starts with, or -1."""
        got = self.shorter.get(r)
        if got is None:
            w = self.words[r]
            got = next((self.rank[w[:k]] for k in range(len(w) - 1, 0, -1) if w[:k] in self.rank), -1)
            self.shorter[r] = got
        return got

    def word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        s = raw.decode("latin-1")
        n, words = len(s), self.words
        longest = [-1] * n
        for end, r in self.trie.iter(s):
            start = end + 1 - len(words[r])
            if longest[start] < 0 or len(words[r]) > len(words[longest[start]]):
                longest[start] = r
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos = 0
        at = longest[0] if n else -1
        while at >= 0:
            last = out[-1] if out else -1
            while True:
                end = pos + len(words[at])
                if open_[end] and (last < 0 or self.compatible(last, at)):
                    out.append(at)
                    pos = end
                    at = longest[pos] if pos < n else -1
                    break
                less = self.prefix(at)
                if less >= 0:
                    at = less
                    continue
                open_[pos] = 0
                out.pop()
                pos -= len(words[last])
                at = last
                break
        return [self.ids[r] for r in out]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null and empty give an empty list."""
        out: list[int] = []
        if not text:
            return out
        seen = self.seen
        for w in self.split(text):
            ids = seen.get(w)
            if ids is None:
                ids = tuple(self.word(w.encode("utf-8", "surrogatepass")))
                if len(w) <= 64:
                    if len(seen) >= WORDS_IN_MEMORY:
                        seen.clear()
                    seen[w] = ids
            out.extend(ids)
        return out


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def vocabulary(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Path of a public vocabulary file; ``folder`` overrides the installed package."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``id_col`` and the token ids of ``text_col``, one row per row of ``df``, narrow (no shuffle).

    Null and empty texts give an empty list, never null; names of special tokens are ordinary text; very long
    texts are encoded whole. A null id stays; repeated rows come out as often as they came in.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Looked up where the task runs: a worker may keep the vocabulary elsewhere than the driver.
        enc = encoder(path or vocabulary())
        for b in batches:
            lists = [enc.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, ids_col]
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>")
