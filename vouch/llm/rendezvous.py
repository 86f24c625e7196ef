"""Sharding by rendezvous (highest random weight) hashing.

Every record key meets every shard once: the pair's hash gives a uniform
number u, and the shard with the smallest -ln(u) / weight takes the record.
A shard's share follows its weight, and adding a shard moves only the records
that the new shard wins.  Built-in functions only.

Defined results: a null key hashes as the word ``null``; a null text has no
bytes; equal rows get the same shard and neighbouring slots; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch.llm.common import running_total, text_or_empty, written

#: 13 hexadecimal digits of an MD5 digest are 52 bits, exact in a double.
_STEPS = float(1 << 52)


def draw(key: Column, shard: int) -> Column:
    """Uniform number in (0, 1) of a (key, shard) pair."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(_STEPS)


def pick_shard(key: Column, weights: list[float]) -> Column:
    """Number of the shard that takes ``key``; equal scores go to the lowest."""
    scores = [F.struct((-F.log(draw(key, s)) / F.lit(float(w))).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_min(F.array(*scores))["shard"]


def record_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def shard_documents(docs: DataFrame, weights: list[float], grown_weight: float | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, grown_shard.

    ``slot`` counts 0, 1, ... without gaps in each shard, ordered by a hash of
    the row.  The first three digits of that hash cut each shard in 4,096
    chunks, which are numbered apart and then shifted by the sizes of the
    chunks before, so no task sees a whole shard.  ``grown_shard`` is the
    shard after one more of ``grown_weight`` (the last weight when not given).
    """
    grown = [*weights, weights[-1] if grown_weight is None else grown_weight]
    raw = F.encode(text_or_empty(), "UTF-8")
    slim = docs.select("doc_id", (F.octet_length(raw).cast("bigint") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    key = record_key()
    slim = slim.select(
        "*", pick_shard(key, weights).alias("shard"), pick_shard(key, grown).alias("grown_shard"),
        F.md5(F.concat_ws(":", key, F.col("text_crc32").cast("string"))).alias("_h"))
    slim = written(slim.withColumn("_chunk", F.substring("_h", 1, 3)), "shards")
    out = running_total(slim, ["shard"], "_chunk", ["_h", "doc_id", "size"], F.lit(1).cast("bigint"), "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: list[float]) -> None:
    """Write whole documents as one folder per shard, in files of even size.

    Rows are dealt by (shard, hash slice) so that one shard is written by many
    tasks.
    """
    key = record_key()
    sliced = docs.withColumn("shard", pick_shard(key, weights))
    sliced.repartition("shard", F.pmod(F.xxhash64(key), F.lit(64))).write.partitionBy("shard").parquet(path)
