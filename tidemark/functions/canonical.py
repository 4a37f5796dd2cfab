"""Canonical JSON and content ids: every digest of the data model, built in the JVM.

Two flavours of separators exist among the stored ids: compact (``,`` and ``:``) and spaced (``, `` and ``: ``).
Keys are always sorted; texts are escaped as JSON demands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    """A string as JSON string (null as ``null``); non-ASCII characters stay as they are."""
    whole = F.to_json(F.struct(c.alias("k")))
    return F.when(c.isNull(), F.lit("null")).otherwise(whole.substr(F.lit(6), F.length(whole) - 6))


def json_object(fields: dict[str, Column], spaced: bool = False) -> Column:
    """JSON object of already rendered values, keys sorted."""
    comma, colon = (", ", ": ") if spaced else (",", ":")
    parts: list[Column] = []
    for n, k in enumerate(sorted(fields)):
        parts += [F.lit(("{" if n == 0 else comma) + f'"{k}"{colon}'), fields[k]]
    return F.concat(*parts, F.lit("}"))


def json_array(values: Column, spaced: bool = False) -> Column:
    """JSON array of an array of strings."""
    inner = F.array_join(F.transform(values, quoted), ", " if spaced else ",")
    return F.concat(F.lit("["), inner, F.lit("]"))


def json_map(m: Column, spaced: bool = False) -> Column:
    """JSON object of a map of strings, keys sorted."""
    comma, colon = (", ", ": ") if spaced else (",", ":")
    entries = F.sort_array(F.map_entries(m))
    inner = F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(colon), quoted(e["value"]))), comma)
    return F.concat(F.lit("{"), inner, F.lit("}"))


def digest(text: Column, size: int = 64) -> Column:
    h = F.sha2(text, 256)
    return h if size == 64 else F.left(h, F.lit(size))


def legacy_signature(source_type: Column, language: Column, bucket: Column) -> Column:
    """Signature of the three legacy factors."""
    return digest(json_object({"source_type": quoted(source_type), "language_profile": quoted(language), "time_bucket": quoted(bucket)}))


def old_signature(factors: Column) -> Column:
    """The earlier, shorter signature of a map of factors (spaced JSON)."""
    return digest(json_map(factors, spaced=True), 32)


def policy_signature(policy_id: str, version: str, factors_json: Column, missing: Column) -> Column:
    """Signature under a policy: ``factors_json`` keeps the types of its values; ``missing`` is a sorted array of keys."""
    parts = {"policy_id": quoted(F.lit(policy_id)), "version": quoted(F.lit(version)), "factors": factors_json, "missing": json_array(missing)}
    return digest(json_object(parts))


def record_id(token: Column, signature: Column) -> Column:
    return digest(json_object({"cond": quoted(signature), "token_norm": quoted(token)}, spaced=True), 32)


def analysis_id(signature: Column, w1_hash: Column, w2_hash: Column, algorithm: str = "KL-PerToken-v1") -> Column:
    parts = {"condition_signature": signature, "w1_snapshot_hash": w1_hash, "w2_snapshot_hash": w2_hash, "algorithm": F.lit(algorithm)}
    return digest(json_object({k: quoted(v) for k, v in parts.items()}, spaced=True), 32)


def projection_id(article: Column, w3_ids: Column, tokenizer: Column, normalizer: Column, algorithm: str = "DotProduct-v1") -> Column:
    """Id of a projection; ``w3_ids`` in the order of their conditions."""
    parts = {"article_id": quoted(article), "tokenizer_version": quoted(tokenizer), "normalizer_version": quoted(normalizer), "algorithm": quoted(F.lit(algorithm))}
    return digest(json_object({**parts, "w3_analysis_ids": json_array(w3_ids, spaced=True)}, spaced=True), 32)


def island_id(members: Column) -> Column:
    """Id of an island from its members alone (order of the array doesn't matter)."""
    return digest(json_object({"members": json_array(F.sort_array(members))}))


def pair_id(a: Column, b: Column, metric: str = "cosine_dist_v1") -> Column:
    return digest(json_object({"island_a": quoted(a), "island_b": quoted(b), "metric": quoted(F.lit(metric))}), 32)


def ids_digest(ids: Column) -> Column:
    """Digest of a set of ids, order and repeats aside."""
    return digest(json_array(F.sort_array(F.array_distinct(ids))), 32)


def fingerprint(atoms: Column, operator_type: Column) -> Column:
    """Identity of a molecule: its atoms in order with the operators it uses."""
    return digest(F.concat(F.array_join(F.sort_array(atoms), "|"), F.lit("::"), operator_type), 32)


def event_id(version: Column, ledger: Column, event_type: Column, direction: Column, data_json: Column) -> Column:
    """Identity of an event's content: time, number and origin left out. ``data_json`` must be canonical."""
    parts = {"v": version.cast("string"), "ledger_id": quoted(ledger), "event_type": quoted(event_type), "direction": quoted(direction), "data": data_json}
    return digest(json_object(parts))


def entry_body(e: dict[str, Column]) -> Column:
    """Canonical body of a ledger entry, of columns v, ledger_id, seq, ts, event_type, direction, data, meta, algo, prev, event_id."""
    chain = json_object({k: quoted(e[k]) for k in ("algo", "prev", "event_id")})
    text = {k: quoted(e[k]) for k in ("ledger_id", "ts", "event_type", "direction")}
    return json_object({**text, "v": e["v"].cast("string"), "seq": e["seq"].cast("string"), "data": e["data"], "meta": e["meta"], "hash": chain})


def self_hash(prev: Column, body: Column) -> Column:
    return digest(F.concat(prev, F.lit("\n"), body))
