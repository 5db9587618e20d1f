"""Sharding by jump consistent hashing: a stable key and the number of shards give the shard.

No ring table is kept; when shards are appended, a key stays or moves into a new shard, and only
the necessary fraction moves. The dealt rows (keys, sizes and checksums, no texts) are stored once
before their slots are numbered.

Cases: a null key hashes as -1; an integer key of any width is itself, any other key its xxhash64, so a key's
shard depends on nothing else in its table. Rows that repeat a key go to the same shard and get slots of their
own, dealt over many tasks. Null text counts as empty: size 1, checksum 0. Very long texts count whole. Other columns of any name
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import gapless, materialize

MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every key in 0..shards - 1 (Lamping and Veach's algorithm over whole arrays)."""
    key = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    going, at = np.arange(len(key)), np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while len(going):
            shard[going] = at
            key[going] = key[going] * MULTIPLIER + np.uint64(1)
            at = ((at + 1) * (2.0**31 / ((key[going] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
            inside = at < shards
            going, at = going[inside], at[inside]
    return shard


def key_of(docs: DataFrame, key: str) -> Column:
    """What a key is dealt by: a long without nulls."""
    whole = isinstance(docs.schema[key].dataType, (ByteType, ShortType, IntegerType, LongType))
    return F.coalesce(F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.lit(-1).cast("long"))


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; slots number each shard's rows from 0 without gaps."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["doc_id", "size", "text_crc32", "uid"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(jump(k, shards), pa.int32()), pa.array(jump(k, shards + 1), pa.int32())], [*names, "shard", "grown_shard"])

    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    rows = docs.select(F.col(key).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("uid"), key_of(docs, key).alias("k"))
    stored = materialize(rows.mapInArrow(dealt, f"doc_id {kind}, size long, text_crc32 long, uid long, shard int, grown_shard int"), "dealt")
    placed = gapless(stored, "shard", "uid", "slot", shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
