"""Operator 7, sharding by weighted rendezvous hashing. DataFrame functions only.

A record goes to the shard with the least -ln(u) / weight, where u is a hash of its key and the shard's number, spread over (0, 1).
Key and shards decide alone, so a new shard takes records only into itself, about its share of the weight.

Nulls: null keys hash like any other value; a null text has 0 bytes and checksum 0. Repeated rows get slots of their own.
An empty table gives no rows. `place` and `write` keep all other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotag.llm.common import running

OVERHEAD = 16
SHARDS = 40


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard (0, 1, ...) of a key among shards of these weights; a weight of 0 takes nothing."""
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights) if w > 0])

    def cost(s):
        u = (F.shiftrightunsigned(F.xxhash64(key, s["shard"]), 11) + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / s["weight"]).alias("cost"), s["shard"].alias("shard"))

    return F.array_min(F.transform(shards, cost))["shard"]


def place(docs: DataFrame, key: str = "doc_id", weights: list[float] | None = None) -> DataFrame:
    """`docs` with `shard`."""
    return docs.withColumn("shard", shard_of(F.col(key).cast("string"), weights or [1.0] * SHARDS))


def layout(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document; slots count a shard's rows from 0."""
    key, text = F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(key, [1.0] * shards).alias("shard"), shard_of(key, [1.0] * (shards + 1)).alias("grown_shard"))
    order = F.md5(F.concat_ws(":", F.coalesce(key, F.lit("-")), F.col("text_crc32"), F.col("size")).cast("binary"))
    rows = running(rows.withColumn("_order", order), ["shard"], [F.col("_order"), F.col("doc_id")], F.lit(1))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", F.col("before").cast("long").alias("slot"), "grown_shard")


def write(docs: DataFrame, path: str, key: str = "doc_id", weights: list[float] | None = None, files_per_shard: int = 1) -> None:
    """One folder per shard with `files_per_shard` files, rows sorted by key."""
    out = place(docs, key, weights).withColumn("_part", F.pmod(F.xxhash64(F.col(key), F.lit("file")), files_per_shard))
    n = len(weights or [1.0] * SHARDS) * files_per_shard
    out.repartition(n, "shard", "_part").sortWithinPartitions("shard", "_part", key).drop("_part").write.partitionBy("shard").parquet(path)
