"""Readers and sinks over files made here; streams against their batch form."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import jsonl as J
from tidemark.sources import sinks as K
from tidemark.streaming import observe as O


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_articles_as_objects_and_lists(spark, tmp_path):
    put(tmp_path / "one.json", json.dumps({"article_id": "a", "text": "é", "source_meta": {"k": "v"}}, indent=1))
    put(tmp_path / "many.json", json.dumps([{"article_id": "b"}, {"article_id": "c"}]))
    put(tmp_path / "bad.json", "{")
    put(tmp_path / "other.txt", "{}")
    got = {r["article_id"]: (r["text"], r["source_meta"]) for r in J.read_articles(spark, str(tmp_path)).collect()}
    assert got == {"a": ("é", {"k": "v"}), "b": (None, None), "c": (None, None)}


def test_lines(spark, tmp_path):
    p = put(tmp_path / "x.jsonl", '{"k": 1}\n\n{"k": 2\n{"k": 3}\n')
    assert sorted(r["k"] for r in J.read_lines(spark, p, "k long").collect()) == [1, 3]
    assert [r["bad"] for r in J.bad_lines(spark, p, "k long").collect()] == ['{"k": 2']
    assert [(r["line"], r["k"]) for r in J.read_until_bad(spark, p, "k long").collect()] == [(0, 1)]
    assert J.read_or_empty(spark, str(tmp_path / "none"), "k long").collect() == []


def test_synapses_and_glossary(spark, tmp_path):
    p = put(tmp_path / "s.json", json.dumps({"_meta": {}, "synapses": {"w.n.01": [{"concept_id": "C", "raw_score": 0.5, "weight": 1.0}, {"concept_id": "D", "raw_score": 0.4}]}}))
    assert [(r["synset_id"], r["rank"], r["concept_id"]) for r in J.read_synapses(spark, p).orderBy("rank").collect()] == [("w.n.01", 0, "C"), ("w.n.01", 1, "D")]
    tree = {"final_json": {"axes": {"t": {"l": {"definition_en": "d"}}}}}
    shapes = [{"C": tree}, {"glossary": {"C": tree}}, {"glossary": [{"concept_id": "C", **tree}]}, [{"concept_id": "C", **tree}]]
    for i, s in enumerate(shapes):
        g = put(tmp_path / f"g{i}.json", json.dumps(s))
        assert [tuple(r) for r in J.read_glossary(spark, g).collect()] == [("C", "t", "l", "d")]


def test_cyclic_and_digest(spark, tmp_path):
    assert [r["text"] for r in J.cyclic(spark, ["a", "b"], 5).orderBy("step").collect()] == list("ababa")
    p = put(tmp_path / "f.txt", "abc")
    assert [tuple(r) for r in J.files_digest(spark, p).collect()] == [("f.txt", "sha256:ba7816bf8f01cfea")]


def test_times_keep_their_microseconds(spark, tmp_path):
    d = spark.sql("select 1 article_id, timestamp '2024-01-01 00:00:00.123456' ingestion_time").select(F.col("article_id").cast("string"), "ingestion_time")
    back = J.read_lines(spark, K.write_lines(d, str(tmp_path / "t")), J.ARTICLE)
    assert back.select(F.unix_micros("ingestion_time")).first()[0] % 10**6 == 123456


def test_append_dedups(spark, tmp_path):
    path = str(tmp_path / "reg")
    d = spark.createDataFrame([("1", {"a:b": "c"}, None), ("1", {"a:b": "c"}, None), ("2", {}, "p")], J.CONTEXT)
    assert K.append_new(d, path, "context_id", J.CONTEXT) == 2 and K.append_new(d, path, "context_id", J.CONTEXT) == 0
    assert J.read_lines(spark, path, J.CONTEXT).count() == 2


def test_same_each_time(spark, tmp_path):
    d = spark.range(50).repartition(7)
    assert K.same_each_time(lambda p: K.write_lines(d, p, ["id"]), [str(tmp_path / n) for n in "abc"], spark)
    seen = iter(range(9))
    assert not K.same_each_time(lambda p: K.write_lines(spark.range(next(seen) + 1), p), [str(tmp_path / n) for n in "de"], spark)


def test_labels(spark):
    d = spark.createDataFrame([("## Topic: x",), ("## 0a1b",)], "t string")
    assert [r[0] for r in d.select(K.names_nothing(F.col("t"))).collect()] == [False, True]


@pytest.mark.parametrize("files", [1, 4])
def test_stream_counts_equal_batch(spark, tmp_path, files):
    rows = [(i, ["a", "b"] if i % 3 else ["a", "a"], f"f{i % 4}") for i in range(40)]
    d = spark.createDataFrame(rows, "seq long, atoms array<string>, formula_signature string")
    d.repartition(files).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r["atom"], r["formula_signature"]): (r["n"], r["seen"], r["last"]) for r in O.drained(O.formula_counts_stream(s), "update", ["atom", "formula_signature"]).collect()}
    e = d.select("seq", F.explode("atoms").alias("atom"), "formula_signature").groupBy("atom", "formula_signature").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"))
    assert got == {(r["atom"], r["formula_signature"]): (r["n"], r["a"], r["b"]) for r in e.collect()}


def test_windows_with_late_rows(spark, tmp_path):
    d = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", "k") for m in (1, 5, 59)], "t string, k string").withColumn("t", F.to_timestamp("t"))
    d.coalesce(1).write.parquet(str(tmp_path / "w"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "w"))
    got = O.drained(O.event_windows(s, "t", "10 minutes", "k"), "update")
    assert sorted(r["n"] for r in got.collect()) == [1, 2]
