"""Segments of articles (sentences, paragraphs, both) as half-open character spans, and facts about them.

A segment's text is always the slice of its article, never a copy that could drift. All segmenters are narrow: no
shuffle, and only lengths leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.canonical import digest, json_object, quoted
from tidemark.functions.spans import PARAGRAPH_BREAK, SPACE, edges, placed, running, sentence_pieces
from tidemark.functions.text import RUN, bigrams

SENTENCE_LEAST, PARAGRAPH_LEAST = 3, 10


def _spans(df: DataFrame, cut: Column, gaps: Column | None, least: int) -> DataFrame:
    """``df`` with ``spans``; ``cut`` and ``gaps`` (lengths of separators after each piece) are made from its columns."""
    kept = df.columns
    d = df.withColumn("_cut", cut).withColumn("_gap", gaps if gaps is not None else F.lit(None).cast("array<int>"))
    lengths = F.transform("_cut", lambda e, i: e["size"] + F.coalesce(F.get("_gap", i), F.lit(0)))
    d = d.withColumn("_starts", running(lengths))
    return d.select(*kept, placed(F.col("_cut"), F.col("_starts"), least).alias("spans"))


def sentence_spans(df: DataFrame, text: str, least: int = SENTENCE_LEAST) -> DataFrame:
    """Adds ``spans`` of sentences; null and blank texts have none (an empty or null array)."""
    return _spans(df, F.transform(sentence_pieces(F.col(text)), edges), None, least)


def paragraph_spans(df: DataFrame, text: str, least: int = PARAGRAPH_LEAST) -> DataFrame:
    """Adds ``spans`` of paragraphs, which empty lines part."""
    gaps = F.transform(F.regexp_extract_all(F.col(text), F.lit(f"({PARAGRAPH_BREAK})"), 1), F.length)
    return _spans(df, F.transform(F.split(F.col(text), PARAGRAPH_BREAK), edges), gaps, least)


def _exploded(df: DataFrame, text: str) -> DataFrame:
    kept = [c for c in df.columns if c != "spans"]
    s = df.select(*kept, F.posexplode("spans").alias("segment_index", "_s"))
    return s.select(*[c for c in kept if c != text], "segment_index", F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), slice_of(F.col(text), F.col("_s.start"), F.col("_s.end")).alias("segment"))


def slice_of(text: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` up to ``end``."""
    return F.substring(text, start + 1, end - start)


def sentences(df: DataFrame, text: str, least: int = SENTENCE_LEAST) -> DataFrame:
    """One row per sentence: the other columns, segment_index, start, end, segment."""
    return _exploded(sentence_spans(df, text, least), text)


def paragraphs(df: DataFrame, text: str, least: int = PARAGRAPH_LEAST) -> DataFrame:
    return _exploded(paragraph_spans(df, text, least), text)


def sentences_in_paragraphs(df: DataFrame, text: str) -> DataFrame:
    """Sentences cut inside each paragraph; a text without any paragraph is cut as a whole. ``segment_index`` runs by paragraph, then sentence."""
    p = paragraph_spans(df, text)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    p = p.withColumn("spans", F.when((F.size("spans") == 0) & F.col(text).isNotNull(), whole).otherwise(F.col("spans")))
    p = _exploded(p, text).withColumnsRenamed({"segment_index": "_p", "start": "_base"}).drop("end")
    s = _exploded(sentence_spans(p, "segment"), "segment")
    return s.select(
        *[c for c in df.columns if c != text],
        (F.col("_p").cast("long") * (2**31) + F.col("segment_index")).alias("segment_index"),
        (F.col("_base") + F.col("start")).alias("start"),
        (F.col("_base") + F.col("end")).alias("end"),
        "segment",
    )


#: Segmenters by name; a user may add their own (a DataFrame and its text column in, rows of segments out).
SEGMENTERS: dict[str, Callable[..., DataFrame]] = {"sentence": sentences, "paragraph": paragraphs, "hybrid": sentences_in_paragraphs}


def segmenter(name: str = "sentence") -> Callable[..., DataFrame]:
    if name not in SEGMENTERS:
        raise ValueError(f"no segmenter {name!r}; there are {sorted(SEGMENTERS)}")
    return SEGMENTERS[name]


def segment_facts(segment: Column) -> Column:
    """Struct (char_count, token_count, has_punctuation, empty): plain counts, words parted by space."""
    words = F.size(F.filter(F.split(segment, f"{SPACE}+"), lambda w: w != ""))
    return F.struct(
        F.length(segment).alias("char_count"), words.alias("token_count"), segment.rlike("[.!?]").alias("has_punctuation"), (words == 0).alias("empty")
    )


def token_spans(df: DataFrame, text: str) -> DataFrame:
    """One row per token with its span: the other columns, surface, start, end. Bigrams overlap by a character."""
    kept = [c for c in df.columns if c != text]
    d = df.select(*kept, F.regexp_extract_all(text, F.lit(f"({RUN})"), 1).alias("_r"), F.transform(F.split(text, RUN), F.length).alias("_g"))
    d = d.withColumn("_starts", running(F.transform("_r", lambda r, i: F.length(r) + F.get("_g", i + 1))))
    runs = d.select(*kept, F.get("_g", F.lit(0)).alias("_lead"), F.posexplode("_r").alias("_i", "_run"), "_starts")
    runs = runs.select(*kept, "_run", (F.col("_lead") + F.get("_starts", F.col("_i"))).alias("_at"))
    pieces = runs.select(*kept, "_at", F.posexplode(F.when(F.ascii("_run") > 127, bigrams(F.col("_run"))).otherwise(F.array("_run"))).alias("_k", "surface"))
    return pieces.select(*kept, "surface", (F.col("_at") + F.col("_k")).alias("start"), (F.col("_at") + F.col("_k") + F.length("surface")).alias("end"))


def prefixed_source(source: Column, kind: str = "A") -> Column:
    """Source id with its kind in front, as it is where it has one."""
    return F.when(source.rlike("^[AD]:"), source).otherwise(F.concat(F.lit(f"{kind}:"), source))


def environment_id(config: dict[str, str]) -> Column:
    """Id of an environment from its settings."""
    return F.concat(F.lit("env_"), digest(json_object({k: quoted(F.lit(v)) for k, v in config.items()}), 12))


def batch_rows(spark, texts: list[str], urls: list[str | None] | None = None, metas: list[dict | None] | None = None) -> DataFrame:
    """Texts given in memory as rows (row, text, source_url, source_meta), paired by position; what is missing is null."""
    at = lambda xs, i: xs[i] if xs is not None and i < len(xs) else None
    rows = [(i, t, at(urls, i), at(metas, i)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "row long, text string, source_url string, source_meta map<string,string>")
