"""Sharding: a two-pass external shuffle with DataFrame functions only.

The first pass scatters the rows by seeded hashes: the shard is the one that wins a rendezvous of hashes
of doc_id and shard number, so one more shard takes rows only into itself; within a shard a hash of the
row's content picks one of as many buckets as keep a bucket near `bucket_bytes`, counted from the shard's own
bytes, so that a shard of many rows has more of them. The second pass puts each bucket in a fixed order, runs
Spark's seeded Fisher-Yates shuffle on it and numbers the rows through the shard. A task takes a few buckets, by a
hash of their number and in its order, so order and random numbers depend on content and seed only, and a task
that runs again gives the same rows.

Null doc_ids share a shard, and are spread over its buckets by their content; rows equal in doc_id and
text are interchangeable, and stay in one bucket, which grows with them. Empty tables give empty results. Input columns named as the added
ones (shard, slot, and grown_shard) are replaced.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, without

SHARDS, BUCKET_BYTES, SEED = 24, 16 << 20, 20_240


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text, null none, and 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose hash with the key is highest."""
    tickets = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), i.alias("i")))
    return F.array_max(tickets)["i"]


def buckets_of(docs: DataFrame, shards: int, bucket_bytes: int, seed: int) -> list[int]:
    """The number of buckets of each shard; one row a shard comes to the driver."""
    sizes = docs.groupBy(shard_of(F.col("doc_id"), shards, seed).alias("shard")).agg(F.sum(row_size(F.col("text"))).alias("bytes"))
    found = {r["shard"]: r["bytes"] for r in sizes.collect()}
    return [max(1, -(-found.get(s, 0) // bucket_bytes)) for s in range(shards)]


def scattered(docs: DataFrame, buckets: list[int], seed: int) -> DataFrame:
    """docs with shard, and bucket numbered through all shards."""
    first = [0, *accumulate(buckets[:-1])]
    of_shard = lambda numbers: F.array(*map(F.lit, numbers))[F.col("shard")]
    within = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text")), of_shard(buckets))
    return docs.withColumn("shard", shard_of(F.col("doc_id"), len(buckets), seed)).withColumn("__bucket", (of_shard(first) + within).cast("int"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """docs with shard and slot, the row's place in its shuffled shard."""
    docs = without(docs, "shard", "slot", "__bucket")
    buckets = buckets_of(docs, shards, bucket_bytes, seed)
    placed = scattered(docs, buckets, seed)
    counts = scattered(docs.select("doc_id", "text"), buckets, seed).groupBy("shard", "__bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    row = F.struct(F.xxhash64(F.lit(seed + 2), F.col("doc_id"), F.col("text")).alias("__order"), *[F.col(f"`{c}`") for c in docs.columns])
    whole = placed.select("shard", "__bucket", row.alias("row")).repartition(sum(buckets), "__bucket")
    grouped = whole.groupBy("shard", "__bucket").agg(F.collect_list("row").alias("rows"))
    sorted_rows = F.array_sort("rows", lambda a, b: (a["__order"] > b["__order"]).cast("int") - (a["__order"] < b["__order"]).cast("int"))
    located = grouped.join(offsets, F.col("__bucket") == F.col("__b"), "left").sortWithinPartitions("__bucket")
    shuffled = located.select("shard", "offset", F.posexplode(F.shuffle(sorted_rows, seed)).alias("at", "row"))
    return shuffled.select(*[F.col(f"row.`{c}`") for c in docs.columns], F.col("shard").cast("int").alias("shard"), (F.col("offset") + F.col("at")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes a folder of files per shard, each in slot order."""
    shard_rows(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(read(spark, sf_dir, "documents"))
    checksum = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    grown = shard_of(F.col("doc_id"), SHARDS + 1)
    return rows.select("doc_id", row_size(F.col("text")).alias("size"), checksum.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", grown.cast("int").alias("grown_shard"))
