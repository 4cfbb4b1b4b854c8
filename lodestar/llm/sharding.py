"""Sharding by jump consistent hashing (Lamping and Veach)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which the rows of one shard are split while they are numbered.
PARTS = 256


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bucket of each unsigned 64-bit key: the last jump below shards."""
    key = keys.astype(np.uint64).copy()
    bucket, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[live] = ((bucket[live] + 1) * (2.0**31 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[ahead[live] < shards]
    return bucket


def jump_hash(key: Column, shards: int) -> Column:
    """jump() of a long column."""

    @F.pandas_udf("int")
    def of(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return of(key)


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard.

    The shard depends on the key and the number of shards alone (law `key`): one more
    shard takes rows only into itself. Rows of an equal key share a shard; rows with a
    null key share the shard of the null. size is the text's UTF-8 bytes plus 16, a
    null text has 0 bytes and CRC-32 0. slot numbers the rows of a shard from 0 without
    gaps, in an order that only equal rows may swap. Columns of docs with a clashing
    name are replaced.
    """
    k = F.xxhash64(F.col(key))
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    # By key and text, so that rows of one key, or of none, spread over the parts as well.
    part = F.pmod(F.xxhash64(F.lit(1), F.col(key), F.col(text)), F.lit(PARTS)).cast("int")
    named = docs.withColumns({"size": (F.octet_length(data) + 16).cast("long"), "text_crc32": F.crc32(data), "law": F.lit("key"), "shard": jump_hash(k, shards), "grown_shard": jump_hash(k, shards + 1), "_part": part})
    # The numbers of earlier rows come from counts: shards x PARTS rows at most, hence safe to broadcast.
    counts = docs.select(jump_hash(k, shards).alias("shard"), part.alias("_part")).groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_part", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(F.col(key), "text_crc32", "size"))
    return named.withColumn("_row", inside).join(F.broadcast(before), ["shard", "_part"]).withColumn("slot", (F.col("_before") + F.col("_row") - 1).cast("long")).drop("_row", "_before", "_part")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    slim = docs.select("doc_id", "text")
    return shard(slim).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
