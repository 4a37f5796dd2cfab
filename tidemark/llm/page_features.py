"""Content and link features of whole pages, computed for a batch at once.

A page becomes tokens by one pattern; everything after that is arithmetic on the batch's token codes. Which words are
common, and so bind sentences together, isn't given but learned from the corpus (``common_counts``).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CHARS = "぀-ヿ㐀-鿿가-힯"
#: Links in markup or bare, tags, single characters of scripts without spaces, words, numbers, and what parts units.
TOKEN = re.compile(
    r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)|https?://\S+|www\.\S+|[a-zA-Z0-9][a-zA-Z0-9-]*(?:\.[a-zA-Z0-9-]+)*\.[a-zA-Z]{2,}\b(?:/\S*)?"
    rf"|[#＃]\w+|[{_CHARS}]|[^\W\d_{_CHARS}]+(?:['’][^\W\d_]+)?|\d+(?:[.,:/-]\d+)*|\n+|[.!?](?=\s)|[。！？|•·»、;]"
)
_CHAR = re.compile(f"[{_CHARS}]$")
LINK, TAG, CHAR, WORD, NUMBER, PART = range(6)
FEATURES = (
    "link_share tag_share plain_share mid_share bound_share stuffed_share twice_share common_share distinct hapax top_token top_pair "
    "pairs_thrice squeezed unit_chars number_rate number_units same_opening part_rate log_chars char_share link_rate"
).split()
_AT = {f: i for i, f in enumerate(FEATURES)}


def _kind(t: str) -> int:
    if t[0] in "\n.!?。！？|•·»、;":
        return PART
    if t[0] in "#＃":
        return TAG
    if t[0] in "<[" or t.startswith(("http", "www.")):
        return LINK
    if _CHAR.match(t):
        return CHAR
    if not any(c.isalpha() for c in t):
        return NUMBER
    return LINK if "." in t or "/" in t else WORD


def is_character(token: str) -> bool:
    """Whether a token is a single character of a script without spaces."""
    return bool(_CHAR.match(token))


class Tokens:
    """The tokens of a batch: ``doc`` and ``code`` of each, and of each code its text, kind and length."""

    def __init__(self, texts: list[str | None]):
        found: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                x = TOKEN.findall(t)
                sizes[i] = len(x)
                found += x
        enc = pc.dictionary_encode(pc.utf8_lower(pa.array(found, pa.string())))
        self.names = enc.dictionary.to_pylist()
        self.code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.kind = np.array([_kind(n) for n in self.names], np.int8)
        self.size = np.array([len(n) for n in self.names], np.int64)
        self.docs = len(texts)


def common_counts(texts: list[str | None], groups: list[str | None]) -> tuple[list[str], list[str], np.ndarray]:
    """Per group and word (or character) of a batch in how many texts it stands; the number of texts under the empty word."""
    t = Tokens(texts)
    names, of = np.unique(np.array([g or "" for g in groups], object).astype(str), return_inverse=True)
    worth = np.flatnonzero((t.kind[t.code] == WORD) | (t.kind[t.code] == CHAR)) if len(t.code) else np.zeros(0, np.int64)
    n = max(1, len(t.names))
    once = np.unique(t.doc[worth] * n + t.code[worth])
    cell, count = np.unique(of[once // n] * n + once % n, return_counts=True)
    g = [str(x) for x in names[cell // n]] + [str(x) for x in names]
    w = [t.names[i] for i in cell % n] + [""] * len(names)
    return g, w, np.concatenate([count, np.bincount(of, minlength=len(names))])


def _most(keys: np.ndarray, owner_of_key, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unique keys, their counts, and the largest count per owner."""
    u, n = np.unique(keys, return_counts=True)
    top = np.zeros(size, np.int64)
    np.maximum.at(top, owner_of_key(u), n)
    return u, n, top


def page_features(texts: list[str | None], common: frozenset[str]) -> np.ndarray:
    """Feature values (rows by texts, columns as ``FEATURES``); null and blank texts have all zeros."""
    t = Tokens(texts)
    out = np.zeros((t.docs, len(FEATURES)))
    if not len(t.code):
        return out
    d, n = t.docs, len(t.names)
    kind, size = t.kind[t.code], t.size[t.code]
    known = np.array([w in common for w in t.names])[t.code]
    per = lambda w: np.bincount(t.doc, weights=w, minlength=d)
    part = kind == PART
    size = np.where(part, 0, size)
    chars = np.maximum(1, per(size))
    word = (kind == WORD) | (kind == CHAR)
    words = np.maximum(1, per(word))
    tokens = np.maximum(1, per(~part))

    def put(name: str, value: np.ndarray) -> None:
        out[:, _AT[name]] = value

    put("link_share", per(size * (kind == LINK)) / chars)
    put("tag_share", per(size * (kind == TAG)) / chars)
    put("link_rate", per(kind == LINK) / tokens)
    put("char_share", per(size * (kind == CHAR)) / chars)
    put("common_share", per(word & known) / words)
    put("number_rate", per(kind == NUMBER) / tokens)
    put("part_rate", per(part) / tokens)
    put("log_chars", np.floor(np.log10(chars)))

    # Units between parting signs.
    unit = np.cumsum(part | np.append(True, t.doc[1:] != t.doc[:-1])) - 1
    units = int(unit[-1]) + 1
    owner = np.zeros(units, np.int64)
    owner[unit] = t.doc
    in_unit = lambda w: np.bincount(unit, weights=w, minlength=units)
    u_size, u_words, u_common = in_unit(size), in_unit(word), in_unit(word & known)
    of_doc = lambda w: np.bincount(owner, weights=w, minlength=d)
    share = u_common / np.maximum(1, u_words)
    put("plain_share", of_doc(u_size * (share < 0.12)) / chars)
    put("mid_share", of_doc(u_size * ((share >= 0.12) & (share < 0.4))) / chars)
    put("bound_share", of_doc(u_size * ((share >= 0.4) & (u_common >= 2))) / chars)
    filled = u_size > 0
    put("unit_chars", chars / np.maximum(1, of_doc(filled)))
    put("number_units", of_doc(u_size * (in_unit(kind == NUMBER) > 0)) / chars)
    content = word & ~known
    _, _, top = _most(unit[content] * n + t.code[content], lambda k: k // n, units)
    stuffed = (top >= 3) & (top >= 0.2 * np.maximum(1, u_words))
    put("stuffed_share", of_doc(u_size * stuffed) / chars)
    # Units that say the same.
    place = np.arange(len(unit)) - np.searchsorted(unit, unit)
    mix = ((t.code + 1) * np.int64(-7046029254386353131)) ^ (place * np.int64(-4658895280553007687))
    mix ^= mix >> 29
    print_ = np.zeros(units, np.int64)
    np.add.at(print_, unit[~part], mix[~part] * np.int64(-4417276706812531889))
    key = np.lexsort((print_, owner))
    same = np.append(False, (print_[key][1:] == print_[key][:-1]) & (owner[key][1:] == owner[key][:-1]))
    again = np.zeros(units, bool)
    again[key] = same | np.append(same[1:], False)
    put("twice_share", of_doc(u_size * (again & filled)) / chars)
    # How alike units open: the kinds of their first two tokens.
    what = np.where(known & word, 6, kind)
    first = np.flatnonzero(~part & (np.append(-1, unit[:-1]) != unit) | (~part & np.append(False, part[:-1])))
    nxt = np.minimum(first + 1, len(unit) - 1)
    shape = what[first] * 8 + np.where(unit[nxt] == unit[first], what[nxt], 7)
    _, _, alike = _most(t.doc[first] * 64 + shape, lambda k: k // 64, d)
    put("same_opening", alike / np.maximum(3, np.bincount(t.doc[first], minlength=d)))

    u, c, _ = _most(t.doc[word] * n + t.code[word], lambda k: k // n, d)
    put("distinct", np.bincount(u // n, minlength=d) / words)
    put("hapax", np.bincount(u // n, weights=c == 1, minlength=d) / words)
    _, _, top = _most(t.doc[content] * n + t.code[content], lambda k: k // n, d)
    put("top_token", top / words)
    pair = np.flatnonzero(word[:-1] & word[1:] & (t.doc[:-1] == t.doc[1:]) & ~(known[:-1] & known[1:]))
    # Pairs are numbered within the batch, so that doc and pair fit one key.
    _, code2 = np.unique(t.code[pair] * n + t.code[pair + 1], return_inverse=True)
    m = int(code2.max()) + 1 if len(code2) else 1
    u, c, top = _most(t.doc[pair] * m + code2, lambda k: k // m, d)
    put("top_pair", top / words)
    put("pairs_thrice", np.bincount(u // m, weights=c * (c >= 3), minlength=d) / words)
    raw = [x.encode("utf-8", "surrogatepass") if x else b"" for x in texts]
    put("squeezed", np.array([len(zlib.compress(r, 1)) / len(r) if r else 0.0 for r in raw]))
    out[per(~part) == 0] = 0.0
    return out
