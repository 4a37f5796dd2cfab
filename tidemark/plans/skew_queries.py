"""Problem 4: totals per heavy key of the conditional token statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.skew import balanced_key_totals, heavy_keys, key_sequences
from tidemark.session import table

FIELDS = ["token_norm", "condition_signature"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(table(spark, sf_dir, "w2_records"), FIELDS, "row_id")


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = balanced_key_totals(table(spark, sf_dir, "w2_records"), FIELDS, "row_id", ["count", "doc_freq"])
    return got.withColumnsRenamed({"lo": "first_row", "hi": "last_row", "count": "total_count", "doc_freq": "total_doc_freq"})


def p4_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on the order of each key's rows: first and last batch, widest gap of row ids, changes of the batch."""
    return key_sequences(table(spark, sf_dir, "w2_records"), FIELDS, "row_id", "batch_no")


QUERIES = {"p4_found": p4_found, "p4_totals": p4_totals, "p4_sequences": p4_sequences}

_LONG = """
select 'token_norm' key_field, token_norm key_value, row_id, batch_no, "count" c, doc_freq d from w2_records
union all select 'condition_signature', condition_signature, row_id, batch_no, "count", doc_freq from w2_records"""
SQL = {
    "p4_found": f"""
select key_field, key_value from ({_LONG}) where key_value is not null
group by 1, 2 having count(*) >= 0.01 * (select count(*) from w2_records)""",
    "p4_totals": f"""
select key_field, key_value, count(*)::bigint n_rows, min(row_id) first_row, max(row_id) last_row,
  coalesce(sum(c), 0)::bigint total_count, coalesce(sum(d), 0)::bigint total_doc_freq
from ({_LONG}) group by 1, 2""",
    "p4_sequences": f"""
with l as (select *, lag(row_id) over w pr, lag(batch_no) over w pb, row_number() over w k from ({_LONG}) where row_id is not null
  window w as (partition by key_field, key_value order by row_id, batch_no nulls first))
select key_field, key_value, count(*)::bigint n_rows, min(row_id) first_at, max(row_id) last_at, arg_min(batch_no, k) filter (k is not null) first_value,
  arg_max(batch_no, k) last_value, coalesce(max(row_id - pr), 0)::bigint widest_gap, (count(*) filter (k > 1 and pb is distinct from batch_no))::bigint changes from l group by 1, 2""",
}
