"""Plain form of text, computed on whole Arrow columns as numpy arrays of code points.

A column is copied once into an array of code points with the row each belongs to. Lookup tables then
delete what is invisible, expand compatibility forms (full width, half width, styled letters, special
spaces) at computed offsets, turn look-alike letters into the word's own script, and compose marks and
syllables, all by gathers and masks; no function is called per row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

N = 0x110000
LATIN, CYRILLIC, GREEK, ARMENIAN = 1, 2, 3, 4
SCRIPTS = {"LATIN": LATIN, "CYRILLIC": CYRILLIC, "GREEK": GREEK, "ARMENIAN": ARMENIAN}

#: Letters that look like a Latin letter, as pairs of look-alike and Latin letter.
TO_LATIN = {
    CYRILLIC: "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԝw ԛq АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԜW ԚQ Ԁd",
    GREEK: "οo ιi νv ρp υu κk αa ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX",
    ARMENIAN: "օo սu հh զq ոn ցg Օo ՍU Լl",
    LATIN: "ɡg ɑa",
}
#: Latin letters that look like a letter of another script.
FROM_LATIN = {
    CYRILLIC: "aа eе oо pр cс yу xх iі jј sѕ hһ AА BВ EЕ KК MМ HН OО PР CС TТ YУ XХ IІ JЈ SЅ",
    GREEK: "oο iι vν pρ uυ kκ aα AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ",
    ARMENIAN: "oօ uս hհ qզ nո gց UՍ",
}


def _pairs(text: str) -> dict[int, int]:
    return {ord(p[0]): ord(p[1]) for p in text.split()}


class Tables:
    """Lookup tables over all code points, built by rule from the Unicode database of the Python in use."""

    def __init__(self) -> None:
        drop = np.zeros(N, bool)
        combining = np.zeros(N, np.uint8)
        letter = np.zeros(N, bool)
        digit = np.zeros(N, bool)
        space = np.zeros(N, bool)
        script = np.zeros(N, np.uint8)
        joins = np.zeros(N, bool)
        virama = np.zeros(N, bool)
        pictograph = np.zeros(N, bool)
        wide: dict[int, str] = {}
        canon: dict[int, str] = {}
        pairs: dict[tuple[int, int], int] = {}
        joiner_scripts = ("ARABIC", "SYRIAC", "MONGOLIAN", "NKO", "PHAGS-PA", "MANDAIC", "MANICHAEAN", "PSALTER")
        for c in range(N):
            if 0xD800 <= c < 0xE000 or 0xAC00 <= c < 0xD7A4:
                letter[c] = 0xAC00 <= c < 0xD7A4
                continue
            ch = chr(c)
            cat = unicodedata.category(ch)
            if cat == "Cn" or cat == "Co":
                continue
            k = unicodedata.combining(ch)
            combining[c] = k
            if k == 9:
                virama[c] = True
            if cat == "Cf" and not (0x600 <= c <= 0x605 or c in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD)):
                drop[c] = True
            elif cat == "Cc" and c not in (9, 10, 13):
                drop[c] = True
            digit[c] = cat == "Nd"
            space[c] = cat[0] == "Z" or c in (9, 10, 13)
            if cat[0] == "L":
                letter[c] = True
                name = unicodedata.name(ch, "")
                script[c] = SCRIPTS.get(name.split(" ", 1)[0], 0)
                joins[c] = name.startswith(joiner_scripts)
            elif cat == "So" and c >= 0x2190:
                pictograph[c] = True
            d = unicodedata.decomposition(ch)
            if d:
                if d[0] == "<":
                    tag = d[1 : d.index(">")]
                    # An accent that stands by itself would become a space with a loose mark.
                    loose = len(k := unicodedata.normalize("NFKC", ch)) > 1 and k[0] == " " and unicodedata.combining(k[1])
                    if tag not in ("super", "sub", "fraction") and not loose:
                        wide[c] = ch
                else:
                    canon[c] = unicodedata.normalize("NFD", ch)
                    two = [int(x, 16) for x in d.split()]
                    if len(two) == 2 and unicodedata.normalize("NFC", ch) == ch:
                        pairs[two[0], two[1]] = c
                    elif len(two) == 1 and unicodedata.normalize("NFC", ch) != ch:
                        wide[c] = ch
        drop[[0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)]] = True
        drop[0xE0000:0xE1000] = True
        self.drop, self.combining, self.letter, self.script = drop, combining, letter, script
        self.digit, self.space = digit, space
        self.joins, self.virama, self.pictograph = joins, virama, pictograph
        self.compat = self._expansion({c: unicodedata.normalize("NFKC", s) for c, s in wide.items() if not drop[c]})
        self.canon = self._expansion(canon)
        keys = sorted(pairs)
        self.pair_keys = np.array([a << 21 | b for a, b in keys], np.int64)
        self.pair_vals = np.array([pairs[k] for k in keys], np.uint32)
        second = np.zeros(N, bool)
        second[[b for _, b in keys]] = True
        second[0x1161:0x1176] = True
        second[0x11A8:0x11C3] = True
        self.second = second
        #: fold[t] maps every letter to script t, own letters to themselves; 0 where there is no way.
        self.fold = {}
        for t in (LATIN, CYRILLIC, GREEK, ARMENIAN):
            f = np.zeros(N, np.uint32)
            own = np.flatnonzero(script == t)
            f[own] = own
            for s, text in TO_LATIN.items():
                to_latin = _pairs(text)
                if t == LATIN or s == t:
                    for a, b in to_latin.items():
                        if t == LATIN:
                            f[a] = b
            if t != LATIN:
                direct = _pairs(FROM_LATIN[t])
                for a, b in direct.items():
                    f[a] = b
                for s, text in TO_LATIN.items():
                    if s != t:
                        for a, b in _pairs(text).items():
                            if b in direct and not f[a]:
                                f[a] = direct[b]
            self.fold[t] = f
        self.plain_ascii = np.zeros(N, bool)
        self.plain_ascii[0x20:0x7F] = True

    @staticmethod
    def _expansion(how: dict[int, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length, start and the joined replacements; length 1 and start -1 where a code point stays."""
        length = np.ones(N, np.int16)
        start = np.full(N, -1, np.int64)
        joined: list[int] = []
        for c, s in how.items():
            length[c], start[c] = len(s), len(joined)
            joined.extend(map(ord, s))
        return length, start, np.array(joined or [0], np.uint32)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def explode_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string column and the row of each (nulls have none)."""
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = bytes(data[int(offsets[0]) : int(offsets[-1])]) if data is not None and len(col) else b""
    cp = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    row_of_byte = np.repeat(np.arange(len(col)), np.diff(offsets)) if len(raw) else np.zeros(0, np.int64)
    row = row_of_byte[lead]
    if col.null_count:
        null = col.is_null().to_numpy(zero_copy_only=False)
        keep = ~null[row]
        cp, row = cp[keep], row[keep]
    return cp, row


def implode_text(cp: np.ndarray, row: np.ndarray, rows: int, null: np.ndarray | None = None) -> pa.Array:
    """The string column of ``rows`` rows made of code points with their rows."""
    raw = cp.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")
    b = np.frombuffer(raw, np.uint8)
    lead = (b & 0xC0) != 0x80
    starts = np.flatnonzero(lead)
    size = np.diff(np.append(starts, len(b)))
    per_row = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(per_row, out=offsets[1:])
    out = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(raw)).cast(pa.string())
    if null is not None and null.any():
        import pyarrow.compute as pc

        out = pc.if_else(pa.array(null), pa.scalar(None, pa.string()), out)
    return out


def _expand(cp: np.ndarray, row: np.ndarray, how: tuple) -> tuple[np.ndarray, np.ndarray]:
    length, start, joined = how
    at = start[cp]
    hit = at >= 0
    if not hit.any():
        return cp, row
    n = length[cp].astype(np.int64)
    total = int(n.sum())
    source = np.repeat(np.arange(len(cp)), n)
    begin = np.cumsum(n) - n
    within = np.arange(total) - begin[source]
    out = cp[source]
    swap = hit[source]
    out[swap] = joined[(at[source] + within)[swap]]
    return out, row[source]


def _drop_invisible(cp: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    gone = t.drop[cp]
    if not gone.any():
        return cp, row
    # A joiner stays where the script needs it: inside an Arabic-type word, after a virama, between pictographs.
    joiner = np.flatnonzero((cp == 0x200C) | (cp == 0x200D))
    if len(joiner):
        last, nxt = len(cp) - 1, np.minimum(joiner + 1, len(cp) - 1)
        prev = np.maximum(joiner - 1, 0)
        has_prev = (joiner > 0) & (row[prev] == row[joiner])
        has_next = (joiner < last) & (row[nxt] == row[joiner])
        p, q = cp[prev], cp[nxt]
        zwnj = cp[joiner] == 0x200C
        keep = has_prev & has_next & ((t.joins[p] & t.joins[q]) | (~zwnj & t.pictograph[q] & (t.pictograph[p] | (p == 0xFE0F) | ((p >= 0x1F3FB) & (p <= 0x1F3FF)))))
        keep |= has_prev & t.virama[p] & (~has_next | t.letter[q])
        gone = gone.copy()
        gone[joiner[keep]] = False
    return cp[~gone], row[~gone]


def _unify(cp: np.ndarray, group: np.ndarray, t: Tables, wished: np.ndarray | None = None) -> np.ndarray:
    """Fold look-alikes within each group (ascending ids) of mixed scripts; a group that no script fits stays.

    Of several scripts that fit the one with most letters is taken, or the ``wished`` one (per group, 0 for none).
    """
    s = t.script[cp]
    lettered = s > 0
    if not lettered.any():
        return cp
    ids, start = np.unique(group, return_index=True)
    count = {k: np.add.reduceat((s == k).astype(np.int64), start) for k in t.fold}
    # Letters of the alphabet outside plain Latin mean work; pure groups of one script stay, but for odd Latin forms.
    kinds = sum((count[k] > 0).astype(np.int64) for k in t.fold)
    odd = np.logical_or.reduceat((s == LATIN) & (t.fold[LATIN][cp] != cp), start)
    work = (kinds > 1) | odd
    if not work.any():
        return cp
    target = _fitting(cp, start, work, count, t, wished)
    per_char = np.repeat(target, np.diff(np.append(start, len(cp))))
    out = cp.copy()
    for k, f in t.fold.items():
        m = (per_char == k) & lettered
        out[m] = f[cp[m]]
    return out


def _fitting(cp: np.ndarray, start: np.ndarray, work: np.ndarray, count: dict, t: Tables, wished: np.ndarray | None = None) -> np.ndarray:
    """The script that all letters of a group can go to, 0 where there is none or no work."""
    lettered = t.script[cp] > 0
    best = np.zeros(len(start), np.int64)
    target = np.zeros(len(start), np.uint8)
    for k, f in t.fold.items():
        fits = np.logical_and.reduceat(~lettered | (f[cp] > 0), start)
        score = np.where(fits & work, count[k] + 1 + (0 if wished is None else (wished == k) * len(cp)), 0)
        better = score > best
        best[better], target[better] = score[better], k
    return target


def _look_alikes(cp: np.ndarray, row: np.ndarray, t: Tables) -> np.ndarray:
    """Fold look-alikes within the parts of each term (letters, marks, digits and apostrophes between separators).

    A part of mixed scripts goes to the script it fits. A part of one script stays, unless all its letters look like
    letters of the script that most letters of the term have; a lone small Greek letter, as in the names of
    substances, stays also then.
    """
    if not (t.script[cp] > LATIN).any() and not ((cp == 0x261) | (cp == 0x251)).any():
        return cp
    cuts = ~t.letter[cp] & (t.combining[cp] == 0) & ~t.digit[cp] & (cp != 0x27) & (cp != 0x2019)
    part = np.cumsum(np.append(True, (row[1:] != row[:-1]) | cuts[1:] | cuts[:-1])) - 1
    kinds = list(t.fold)
    # Where a part fits several scripts, the term decides, its single letters aside.
    letters = np.bincount(part, weights=t.script[cp] > 0)
    m = np.flatnonzero((letters[part] > 1) & (t.script[cp] > 0))
    wish = np.zeros(int(row[-1]) + 1, np.uint8)
    if len(m):
        rows, start = np.unique(row[m], return_index=True)
        count = {k: np.add.reduceat((t.script[cp[m]] == k).astype(np.int64), start) for k in kinds}
        wish[rows] = _fitting(cp[m], start, np.ones(len(rows), bool), count, t)
    parts = int(part[-1]) + 1
    row_of = np.zeros(parts, np.int64)
    row_of[part] = row
    out = _unify(cp, part, t, wish[row_of])
    s = t.script[out]
    by_row = np.array([np.bincount(row, weights=s == k, minlength=int(row[-1]) + 1) for k in kinds])
    mixed = (by_row > 0).sum(0) > 1
    if not mixed[row].any():
        return out
    own = np.array([np.bincount(part, weights=s == k, minlength=parts) for k in kinds])
    to = by_row.argmax(0)[row_of]
    lone = (own.sum(0) == 1) & (own[kinds.index(GREEK)] == 1) & (np.bincount(part, weights=(out > 0x3B0) & (out < 0x3CA) & (out != 0x3BF), minlength=parts) == 1)
    pure = ((own > 0).sum(0) == 1) & (own.argmax(0) != to) & mixed[row_of] & ~lone & (by_row.max(0)[row_of] > own.sum(0))
    for i, k in enumerate(kinds):
        no = np.bincount(part, weights=(s > 0) & (t.fold[k][out] == 0), minlength=parts)
        m = (pure & (to == i) & (no == 0))[part] & (s > 0)
        out[m] = t.fold[k][out[m]]
    return out


def _compose(cp: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    if not t.second[cp].any() and not (t.combining[cp] > 0).any():
        return cp, row
    touched = np.unique(row[(t.combining[cp] > 0) | t.second[cp]])
    m = np.isin(row, touched)
    a, r = _expand(cp[m], row[m], t.canon)
    ccc = t.combining[a].astype(np.int64)
    if (ccc > 0).any():
        run = np.cumsum((ccc == 0) | np.append(True, r[1:] != r[:-1]))
        order = np.lexsort((np.arange(len(a)), ccc, run))
        a, r, ccc = a[order], r[order], ccc[order]
    # Compose starter by starter: step j looks at the j-th follower of every starter.
    alive = np.ones(len(a), bool)
    starter = ccc == 0
    base = np.maximum.accumulate(np.where(starter, np.arange(len(a)), 0))
    first_of_row = np.searchsorted(r, r, "left")
    base = np.where(base < first_of_row, -1, base)
    # Followers that are marks, by their place after the starter.
    place = np.arange(len(a)) - base
    marks = np.flatnonzero(~starter & (base >= 0))
    blocked_at = np.zeros(len(a), np.int64)
    if len(marks):
        for j in range(1, int(place[marks].max()) + 1):
            k = marks[place[marks] == j]
            b = base[k]
            key = a[b].astype(np.int64) << 21 | a[k].astype(np.int64)
            at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
            free = blocked_at[b] < ccc[k]
            hit = free & (t.pair_keys[at] == key)
            a[b[hit]] = t.pair_vals[at[hit]]
            alive[k[hit]] = False
            blocked_at[b[~hit]] = np.maximum(blocked_at[b[~hit]], ccc[k[~hit]])
    a, r, ccc = a[alive], r[alive], ccc[alive]
    # Starters that compose with the starter right before them (syllables and some vowel signs), till nothing changes.
    while len(a) > 1:
        x, y = a[:-1].astype(np.int64), a[1:].astype(np.int64)
        same = r[1:] == r[:-1]
        lv = same & (x >= 0x1100) & (x < 0x1113) & (y >= 0x1161) & (y < 0x1176)
        lvt = same & (x >= 0xAC00) & (x < 0xD7A4) & ((x - 0xAC00) % 28 == 0) & (y > 0x11A7) & (y < 0x11C3)
        key = x << 21 | y
        at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        other = same & (ccc[1:] == 0) & (ccc[:-1] == 0) & (t.pair_keys[at] == key)
        hit = lv | lvt | other
        hit[1:] &= ~hit[:-1]
        if not hit.any():
            break
        made = np.where(lv, 0xAC00 + ((x - 0x1100) * 21 + (y - 0x1161)) * 28, np.where(lvt, x + (y - 0x11A7), t.pair_vals[at]))
        i = np.flatnonzero(hit)
        a[i] = made[i]
        keep = np.ones(len(a), bool)
        keep[i + 1] = False
        a, r, ccc = a[keep], r[keep], ccc[keep]
    cp = np.concatenate([cp[~m], a])
    row = np.concatenate([row[~m], r])
    order = np.argsort(row, kind="stable")
    return cp[order], row[order]


def _strip(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(cp):
        return cp, row
    solid = np.flatnonzero(cp != 0x20)
    rows, first = np.unique(row[solid], return_index=True)
    last = np.append(first[1:], len(solid)) - 1
    lo = np.full(int(row[-1]) + 1, len(cp), np.int64)
    hi = np.full(int(row[-1]) + 1, -1, np.int64)
    lo[rows], hi[rows] = solid[first], solid[last]
    i = np.arange(len(cp))
    keep = (i >= lo[row]) & (i <= hi[row])
    return cp[keep], row[keep]


def plain_points(cp: np.ndarray, row: np.ndarray, words: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Plain form of exploded text. ``words``: each row is one term (look-alikes by term, ends stripped);
    otherwise rows are running text, whose look-alikes are folded word by word."""
    t = tables()
    cp, row = _drop_invisible(cp, row, t)
    cp, row = _expand(cp, row, t.compat)
    if words:
        cp = np.where(t.space[cp], np.uint32(0x20), cp)
        if len(cp):
            cp = _look_alikes(cp, row, t)
    elif (t.script[cp] > LATIN).any():
        gap = ~t.letter[cp] & (t.combining[cp] == 0)
        word = np.cumsum(np.append(True, (row[1:] != row[:-1]) | gap[1:] | gap[:-1]))
        cp = _unify(cp, word, t)
    cp, row = _compose(cp, row, t)
    return _strip(cp, row) if words else (cp, row)


def plain_column(col: pa.Array, words: bool = True) -> pa.Array:
    """Plain form of every text of a column; null stays null, a text of invisible characters becomes empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    null = col.is_null().to_numpy(zero_copy_only=False) if col.null_count else None
    cp, row = explode_text(col)
    cp, row = plain_points(cp, row, words)
    return implode_text(cp, row, len(col), null)
