"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions only.

Each shard bids for a key with a number drawn from the hash of both, over the shard's weight; the best bid has the record. A bid depends on
no other shard, so one more shard takes only the records for which it bids best, and a shard of twice the weight holds twice the records.
The hash is MD5 of the key's text and the shard's number, so the law is the same in every engine and release.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditkit.operators.cumulate import cumulate


def bid(key: Column, shard: Column, weight: Column) -> Column:
    """What a shard asks for a key: less is better. Exponential with the weight as its rate."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), shard.cast("string"))), 1, 13), 16, 10)
    return -F.log((drawn.cast("double") + 0.5) / float(2**52)) / weight


def shard_of(key: Column, weights: list[float]) -> Column:
    """Number of the shard that has the key; of equal bids the lower number. All null keys are one key, that of an empty text."""
    numbered = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights) if w > 0])
    bids = F.transform(numbered, lambda s: F.struct(bid(key, s["shard"], s["weight"]).alias("bid"), s["shard"].alias("shard")))
    return F.array_min(bids)["shard"]


def assign(docs: DataFrame, weights: list[float], more: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard for each row of ``docs``.

    size is the UTF-8 bytes of the text plus 8, null as none; grown_shard is the shard once one more of weight ``more`` is there, or null
    without. slot counts a shard's rows from 0 without gaps, in the order of key (null first), size and checksum; it needs no shard in one task. Rows that
    repeat a key are in its shard, each in a slot of its own; rows without a key share one shard. A weight of 0 or less takes no row.
    An empty table gives no row; other columns are not looked at."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    here = shard_of(F.col(key), weights)
    # One more shard changes nothing among the others, so it has to be compared with the best of them alone.
    rated = F.array(*[F.lit(float(w)) for w in weights])
    grown = F.lit(None).cast("int")
    if more is not None and more > 0:
        new = F.lit(len(weights))
        grown = F.when(bid(F.col("key"), new, F.lit(float(more))) < bid(F.col("key"), F.col("shard"), F.get(rated, "shard")), new).otherwise(F.col("shard"))
    narrow = docs.select(F.col(key).alias("key"), size.alias("size"), crc.alias("text_crc32"), here.alias("shard")).withColumn("grown_shard", grown)
    # Rows alike are one row with a count while slots are found, so no number of repeats meets in one range.
    alike = narrow.groupBy("shard", "key", "size", "text_crc32", "grown_shard").agg(F.count("*").alias("n"))
    placed = cumulate(alike, ["shard"], ["key", "size", "text_crc32"], ["n"])
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 4096"))))
    slots = F.sequence(F.col("run") * 4096, F.least(F.col("run") * 4096 + 4095, F.col("n") - 1))
    return runs.withColumn("nth", F.explode(slots)).select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("n_before") + F.col("nth")).cast("long").alias("slot"), "grown_shard")
