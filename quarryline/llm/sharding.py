"""Rendezvous hashing of stable record keys over weighted shards.

Every shard scores a key by -ln(u) / weight, u being uniform in (0, 1) from the MD5 of key and shard;
the lowest score wins. A shard's score depends on nothing but the key and that shard, so a new shard
takes records only into itself, in proportion to its weight, and a removed one gives up only its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_SPAN = float(1 << 52)


def shard_of(key: Column, shards: Mapping[int, float] | Sequence[int]) -> Column:
    """The shard of a string key. shards: shard id to weight, or ids of equal weight. Shards of weight 0
    get nothing. A null key counts as one fixed key of its own. Ties go to the lower shard id."""
    weights = dict(shards) if isinstance(shards, Mapping) else {s: 1.0 for s in shards}
    if not any(w > 0 for w in weights.values()):
        raise ValueError("no shard has a positive weight")
    known = F.coalesce(key.cast("string"), F.lit("\x00null"))
    scored = []
    for shard, weight in sorted(weights.items()):
        if weight > 0:
            digits = F.conv(F.substring(F.md5(F.concat(known, F.lit(f"/{shard}"))), 1, 13), 16, 10).cast("double")
            scored.append(F.struct((-F.ln((digits + 0.5) / _SPAN) / float(weight)).alias("score"), F.lit(int(shard)).alias("shard")))
    return (F.least(*scored) if len(scored) > 1 else scored[0])["shard"]


def assign(docs: DataFrame, shards, grown=None, id_col: str = "doc_id", text_col: str = "text", seq_col: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard, slot), a row per input row.

    slot numbers a shard's rows from 0 without gaps in the order of doc_id, whatever their number: rows
    are range-partitioned by (shard, doc_id, row), numbered inside their task, and shifted by a prefix
    sum over one count per task and shard, so neither a large shard nor one repeated id meets in a
    task. Null ids come first; null texts have no bytes (size 8, CRC-32 0); rows with equal ids get
    neighbouring slots in no set order. Columns other than id and text aren't carried. An empty table
    gives an empty one."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        shard_of(F.col(id_col), shards).cast("int").alias("shard"),
        (shard_of(F.col(id_col), grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    narrow = C.stored(narrow, "shards")
    order = ["shard", "doc_id", "_row"]
    ranged = narrow.repartitionByRange(C.partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    rows = C.numbered(ranged, ["shard"], "slots")
    base = C.prefix_offsets(rows, ["shard"]).select("shard", "_part", "_base")
    out = rows.join(base, ["shard", "_part"])
    return out.select("doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("_local") + F.col("_base")).alias("slot"))


def moved(assigned: DataFrame) -> DataFrame:
    """(shard, grown_shard, n): the rows that a change of the shards moves."""
    return assigned.filter(F.col("shard") != F.col("grown_shard")).groupBy("shard", "grown_shard").agg(F.count(F.lit(1)).alias("n"))


def query(spark, sf_dir: str) -> DataFrame:
    out = assign(C.table(spark, sf_dir, "documents"), range(24), range(25))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, chr(0) || 'null') AS k FROM documents),
s AS (SELECT doc_id, (strlen(t) + 8)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(t), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, x: xor(c >> 8, ({_crc_table()})[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32,
    list_transform(range(25), lambda i: -ln((('0x' || substr(md5(k || '/' || i), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)) AS sc FROM d),
p AS (SELECT *, (list_position(sc[1:24], list_min(sc[1:24])) - 1)::INT AS shard, (list_position(sc, list_min(sc)) - 1)::INT AS grown_shard FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, grown_shard FROM p
"""
