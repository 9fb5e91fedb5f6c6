"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import documents, nested, with_slots


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """Shard of a key: the shard with the greatest w / -ln(u), u from a hash of key and shard.

    A shard's value for a key depends on nothing but key, shard and weight, so one more
    shard takes keys only into itself, and each shard gets keys in proportion to its weight.
    Equal values go to the smaller shard. A null key is a key like any other.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights: at least one above 0, none below")
    bids = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(shard), key), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        bids.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("bid"), F.lit(-shard).alias("minus")))
    best = F.greatest(*bids) if len(bids) > 1 else bids[0]
    return (-best["minus"]).cast("int")


def shard_documents(
    docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0, rows_per_bucket: int = 50_000, seed: int = 0
) -> DataFrame:
    """Columns of `docs` with size, text_crc32, law, shard, slot and grown_shard.

    size is the text's UTF-8 bytes plus 1 (null text: 1). slot numbers a shard's rows from 0
    by hash bucket of key and checksum, then key and checksum, so rows of one key but other texts don't meet in one task; rows alike in both are interchangeable.
    grown_shard is the shard with one more shard of `grown_weight`. Repeated keys share a
    shard, an empty table gives no rows, and columns of docs named like a result are replaced.
    """
    names = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    own, body = F.col("row").getField(key), F.coalesce(F.col("row").getField(text), F.lit(""))
    rows = nested(docs).select(
        "row",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(own, weights, seed).alias("shard"),
        rendezvous(own, [*weights, grown_weight], seed).alias("grown_shard"),
    )
    buckets = 1 + docs.count() // (rows_per_bucket * len(weights))
    placed = with_slots(rows, ["shard"], [own, F.col("text_crc32"), F.col("size")], F.struct(F.lit(seed + 1), own, F.col("text_crc32")), buckets, "slot")
    kept = [c for c in docs.columns if c.lower() not in names or c in (key, text)]
    return placed.select(*[F.col("row").getField(c).alias(c) for c in kept], *[F.col(n) for n in names if n not in kept])


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return shard_documents(docs, [1.0] * 16).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
