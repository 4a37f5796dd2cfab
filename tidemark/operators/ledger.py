"""Hash-chained ledgers: writing (sequential per ledger), and validation, which runs in parallel."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.canonical import entry_body, event_id, self_hash
from tidemark.operators.scan import scan_by_key

# Fixed values of the format.
VERSION, ALGORITHM, FIRST_PREV = 1, "sha256", "0" * 64
GENESIS_DATA = '{"message":"Aru - There is"}'


def with_genesis(events: DataFrame) -> DataFrame:
    """Events with one opening row per ledger and ``seq`` from 0.

    ``events``: ledger_id, at (sortable), row_id, ts (text), event_type, direction, data and meta (canonical JSON).
    """
    seq = F.row_number().over(Window.partitionBy("ledger_id").orderBy("at", "row_id"))
    e = events.withColumn("seq", seq.cast("long"))
    g = events.groupBy("ledger_id").agg(F.min_by(F.struct("at", "row_id", "ts"), F.struct("at", "row_id")).alias("v"))
    meta = '{"actor":"System","engine_version":"1"}'
    g = g.select("ledger_id", "v.*").withColumns({"event_type": F.lit("genesis"), "direction": F.lit("=>"), "data": F.lit(GENESIS_DATA), "meta": F.lit(meta), "seq": F.lit(0).cast("long")})
    return e.unionByName(g)


def _body_parts(df: DataFrame) -> DataFrame:
    """Adds event_id, and the canonical body as the texts before and after the previous hash."""
    d = df.withColumns({"v": F.coalesce(F.col("v"), F.lit(VERSION)) if "v" in df.columns else F.lit(VERSION), "algo": F.lit(ALGORITHM)})
    return d.withColumn("event_id", event_id(F.col("v"), F.col("ledger_id"), F.col("event_type"), F.col("direction"), F.col("data")))


def chained(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """The ledger: the rows of ``with_genesis`` with v, algo, prev, event_id and self.

    Everything but the chain itself is made in the JVM; the scan only hashes.
    """
    d = _body_parts(events)
    body = entry_body({**{c: F.col(c) for c in ("v", "ledger_id", "seq", "ts", "event_type", "direction", "data", "meta", "algo", "event_id")}, "prev": F.lit("PREV")})
    d = d.withColumn("_b", body)

    def step(state: dict | None, row: dict) -> tuple[dict, dict]:
        prev = state["self"] if state else FIRST_PREV
        whole = prev + "\n" + '"prev":"{}"'.format(prev).join(row["_b"].rsplit('"prev":"PREV"', 1))
        own = hashlib.sha256(whole.encode()).hexdigest()
        return {"self": own}, {"ledger_id": row["ledger_id"], "seq": row["seq"], "prev": prev, "self": own}

    links = scan_by_key(d.select("ledger_id", "seq", "_b"), ["ledger_id"], ["seq"], step, "ledger_id string, seq long, prev string, self string", partitions)
    return d.drop("_b").join(links, ["ledger_id", "seq"])


def faults(ledger: DataFrame, line: str = "line") -> DataFrame:
    """Faults of a ledger as (ledger_id, line, code): T861 own hash, T862 link, T863 no entry, T864 number, T865 header.

    ``line`` orders the entries as stored; an unreadable one has a null ``seq``. Each line is checked against the one
    before it, so all lines are checked at once; a broken hash isn't carried on to later lines.
    """
    w = Window.partitionBy("ledger_id").orderBy(line)
    readable = ledger.filter(F.col("seq").isNotNull())
    prev = F.coalesce(F.lag("self").over(w), F.lit(FIRST_PREV))
    before = F.coalesce(F.lag("seq").over(w), F.lit(-1))
    body = entry_body({c: F.col(c) for c in ("v", "ledger_id", "seq", "ts", "event_type", "direction", "data", "meta", "algo", "prev", "event_id")})
    d = readable.withColumns({"_p": prev, "_n": before + 1, "_b": body})
    checks = {
        "T861": F.coalesce(F.col("self") != self_hash(F.col("_p"), F.col("_b")), F.lit(True)),
        "T862": ~F.col("prev").eqNullSafe(F.col("_p")),
        "T864": F.col("seq") != F.col("_n"),
        "T865": ~F.col("v").eqNullSafe(F.lit(VERSION)) | ~F.col("algo").eqNullSafe(F.lit(ALGORITHM)),
    }
    codes = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    found = d.select("ledger_id", line, F.explode(codes).alias("code"))
    torn = ledger.filter(F.col("seq").isNull()).select("ledger_id", line, F.lit("T863").alias("code"))
    return found.unionByName(torn)
