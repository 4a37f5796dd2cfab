"""JSON and JSON-lines files as tables: articles, statistics, ledgers, registries, queues and vote logs.

Readers take explicit schemas, so nothing is inferred by a pass over the data, and leave pruning to Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Times keep their microseconds, which the usual format of JSON files drops.
TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
ARTICLE = "article_id string, text string, source_url string, source_meta map<string,string>, ingestion_time timestamp"
W2 = "record_id string, token_norm string, cond string, count long, doc_freq long, entropy double, top_form string"
LEDGER = (
    "v int, ledger_id string, seq long, ts string, event_type string, direction string, data string, "
    "meta string, hash struct<algo:string,prev:string,event_id:string,self:string>"
)
CONTEXT = "context_id string, traces map<string,string>, retrieval_path string"


def _with_bad(schema: str) -> T.StructType:
    fields = T._parse_datatype_string(schema).fields
    return T.StructType([*fields, T.StructField("_bad", T.StringType())])


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a file or folder of ``*.json``; each file holds one object or a list of objects. Unreadable files give no row."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    row = f"struct<{', '.join(':'.join(f.split(' ', 1)) for f in ARTICLE.split(', '))}>"
    how = {"timestampFormat": TIMES}
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{row}>", how)).otherwise(F.array(F.from_json("value", row, how)))
    return files.select(F.explode(rows).alias("a")).filter("a.article_id is not null or a.text is not null").select("a.*")


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", _with_bad(schema), {"columnNameOfCorruptRecord": "_bad", "timestampFormat": TIMES}).alias("row"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, bad ones left out."""
    return _parsed(spark, path, schema).filter("row._bad is null").select("row.*").drop("_bad")


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines (bad) that ``read_lines`` leaves out."""
    return _parsed(spark, path, schema).select(F.col("row._bad").alias("bad")).filter("bad is not null")


def read_until_bad(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of each file up to its first bad line, with file and line number.

    Files are read whole by one task each, as the rule depends on the order of lines in a file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    lines = lines.filter(F.trim("text") != "")
    parsed = lines.withColumn("row", F.from_json("text", _with_bad(schema), {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    first = F.min(F.when(bad, F.col("line"))).over(Window.partitionBy("file"))
    return parsed.withColumn("_f", first).filter(F.col("_f").isNull() | (F.col("line") < F.col("_f"))).select("file", "line", "row.*").drop("_bad")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines, or an empty table where the path doesn't exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return read_lines(spark, path, schema) if there else spark.createDataFrame([], schema)


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("v")).select(key, "v.*")


def read_synapses(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a synapse file ``{"synapses": {synset: [edge, ...]}}``: one row per edge with its rank in the list."""
    edge = "struct<concept_id:string,axis:string,level:string,raw_score:double,weight:double>"
    d = spark.read.schema(f"synapses map<string,array<{edge}>>").option("multiLine", True).json(path)
    return d.select(F.explode("synapses").alias("synset_id", "edges")).select("synset_id", F.posexplode("edges").alias("rank", "e")).select("synset_id", "rank", "e.*")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Levels of a glossary as concept_id, axis, level, definition: a map of concepts, alone or under ``glossary``."""
    text = spark.read.text(path, wholetext=True)
    level = "struct<definition_en:string>"
    axes = f"struct<final_json:struct<axes:map<string,map<string,{level}>>>>"
    plain = F.from_json("value", f"map<string,{axes}>")
    under = F.from_json(F.get_json_object("value", "$.glossary"), f"map<string,{axes}>")
    listed = F.from_json(F.coalesce(F.get_json_object("value", "$.glossary"), F.col("value")), f"array<struct<concept_id:string,final_json:struct<axes:map<string,map<string,{level}>>>>>")
    one = text.select(F.coalesce(under, F.when(F.get_json_object("value", "$.glossary").isNull() & ~F.ltrim("value").startswith("["), plain)).alias("m"), listed.alias("l"))
    of_map = one.select(F.explode("m").alias("concept_id", "c")).select("concept_id", F.explode("c.final_json.axes").alias("axis", "levels"))
    of_list = one.select(F.explode("l").alias("c")).filter("c.concept_id is not null").select("c.concept_id", F.explode("c.final_json.axes").alias("axis", "levels"))
    return of_map.unionByName(of_list).select("concept_id", "axis", F.explode("levels").alias("level", "d")).select("concept_id", "axis", "level", F.col("d.definition_en").alias("definition"))


def cyclic(spark: SparkSession, texts: list[str], steps: int) -> DataFrame:
    """``steps`` rows (step, text) that go round a fixed list of texts."""
    arr = F.array(*map(F.lit, texts))
    return spark.range(steps).select(F.col("id").alias("step"), F.get(arr, (F.col("id") % len(texts)).cast("int")).alias("text"))


def files_digest(spark: SparkSession, path: str) -> DataFrame:
    """Digest of each file's bytes (16 characters), by name."""
    b = spark.read.format("binaryFile").load(path)
    return b.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.concat(F.lit("sha256:"), F.left(F.sha2("content", 256), F.lit(16))).alias("digest"))
