"""Text functions as column builders: tokens, normal form, validity, word lists, n-grams and typo scores.

Everything here stays in the JVM. A column builder takes and gives a ``Column`` and may be used in any plan.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of words with optional apostrophe, and the five ranges read by bigrams.
WORD = "[a-zA-Z0-9]+(?:'[a-zA-Z]+)?"
CJK = "一-鿿぀-ゟ゠-ヿ가-힯㐀-䶿"
RUN = f"{WORD}|[{CJK}]+"
NORMALIZER_VERSION = "v9.1.0"

# Words that carry no content.
STOPWORDS = (
    "i you your yours he she they we me him her us them my mine his hers its our ours their theirs "
    "myself yourself himself herself itself ourselves themselves "
    "am is are was were be been being do did does done doing have has had having "
    "can could will would shall should may might must "
    "a an the this that these those some any no every "
    "to of in on at by for with from into onto upon about after before between under over through during "
    "and or but nor so yet both either neither "
    "again also already always never ever just only very too quite rather really still even almost "
    "now then here there when where how why what which who whom whose it as if not than such like"
).split()
MIN_WORD = 2

# Words that a short unknown word may be a slip of, and the limits of the search.
TYPO_WORDS = (
    "oops hello love like make take give have come work play help need want know think "
    "feel look find tell call leave keep begin seem show hear turn start might should could"
).split()
TYPO_DISTANCE, TYPO_LEAST = 2, 0.7

#: What edge punctuation is: anything but letters, numbers, underscore and space.
_EDGE = r"[^\p{L}\p{N}_\s]+"
_MARKS = "゙゚"


def kana_forms() -> dict[str, str]:
    """Two-character strings of the read ranges that NFKC composes, by the rule of ``unicodedata``."""
    out = {}
    for c in range(0x3041, 0x3100):
        for m in _MARKS:
            pair = chr(c) + m
            n = unicodedata.normalize("NFKC", pair)
            if n != pair:
                out[pair] = n
    return out


def kana_singles() -> dict[str, str]:
    """Single characters of the read ranges that NFKC changes."""
    return {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x3041, 0x3100) if unicodedata.normalize("NFKC", chr(c)) != chr(c)}


def runs(text: Column) -> Column:
    """Words and unbroken runs of the bigram ranges, in the order of the text."""
    return F.regexp_extract_all(text, F.lit(f"({RUN})"), 1)


def english_tokens(text: Column) -> Column:
    """Words as they stand (null text gives null)."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def bigrams(run: Column) -> Column:
    """Overlapping pairs of characters; a single character stays alone."""
    return F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array(run))


def cjk_bigrams(text: Column) -> Column:
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"([{CJK}]+)"), 1), bigrams))


def hybrid_tokens(text: Column) -> Column:
    """Words and bigrams together in the order of the text."""
    return F.flatten(F.transform(runs(text), lambda r: F.when(F.ascii(r) > 127, bigrams(r)).otherwise(F.array(r))))


#: Tokenizers by the name that a caller gives; each is (version, column builder). Users may add their own.
TOKENIZERS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "english": ("english_word_v1", english_tokens),
    "cjk": ("cjk_bigram_v1", cjk_bigrams),
    "hybrid": ("hybrid_v1", hybrid_tokens),
}


def tokenizer(name: str = "hybrid") -> Callable[[Column], Column]:
    if name not in TOKENIZERS:
        raise ValueError(f"no tokenizer {name!r}; there are {sorted(TOKENIZERS)}")
    return TOKENIZERS[name][1]


def normalized(token: Column) -> Column:
    """Normal form of a token made by one of the tokenizers, null where nothing is left.

    Compatibility form and lower case, then punctuation and spaces off the ends. Of the characters these
    tokenizers let through only kana with sound marks have another compatibility form, so a small map does;
    ``functions.unicode.normalized_any`` covers any text.
    """
    composed = F.create_map(*[F.lit(x) for kv in kana_forms().items() for x in kv])
    slow = token
    for a, b in kana_singles().items():
        slow = F.replace(slow, F.lit(a), F.lit(b))
    rare = _MARKS + "".join(kana_singles())
    plain = F.when(token.rlike(f"[{rare}]"), F.coalesce(F.try_element_at(composed, token), slow)).otherwise(F.lower(token))
    cut = F.regexp_replace(F.regexp_replace(plain, f"^{_EDGE}", ""), f"{_EDGE}$", "")
    cleaned = F.when(F.octet_length(plain) == F.length(plain), plain).otherwise(F.trim(cut))
    return F.nullif(cleaned, F.lit(""))


def valid_token(token: Column, least: int = 1) -> Column:
    """Whether a normal form is counted: long enough and with a letter or number."""
    return F.coalesce((F.length(token) >= least) & token.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def plain_words(text: Column) -> Column:
    """Lower-case words of letters, digits and inner apostrophes, all other signs read as spaces."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9'\s]", " "), r"\s+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "^'+|'+$", "")), lambda w: w != "")


def sensor_words(text: Column) -> Column:
    """``plain_words`` of at least two characters."""
    return F.filter(plain_words(text), lambda w: F.length(w) >= MIN_WORD)


def trigger_words(text: Column) -> Column:
    """Runs of the letters a to z of the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)


def is_noise(word: Column) -> Column:
    """Whether a word is skipped: too short or one of the stopwords."""
    return (F.length(word) < MIN_WORD) | word.isin(STOPWORDS)


def ngrams(words: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` neighbouring words, joined by spaces, shorter ones first.

    ``words`` should be a plain column: it is read once per run.
    """
    of = lambda n: F.when(
        F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    ).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[of(n) for n in range(low, high + 1)]))


def typo_confidence(distance: Column, length: Column, other: Column) -> Column:
    """How likely a word is a slip of another at an edit ``distance``, both lengths given."""
    gap, top = F.abs(length - other), F.greatest(length, other)
    return F.when((distance == 1) & (gap <= 1), 0.85 - 0.1 * gap).otherwise((1 - distance / 3.0) * (1 - gap / top))
