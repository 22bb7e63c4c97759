"""Sharding by jump consistent hashing.

The hash walks the shard counts at which a key would have jumped, so no ring
table is kept and a grown shard count moves only the keys of the new shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise, partitions, released

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; ``shards`` is at least 1."""
    key = np.array(keys, np.uint64)
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = ahead[live]
        key[live] = key[live] * _STEP + np.uint64(1)
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def with_shards(df: DataFrame, shards: int) -> DataFrame:
    """``df`` (doc_id, size, text_crc32) with the shard of each id, and the one with one shard more; a null id counts as -1."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).fill_null(-1).to_numpy().view(np.uint64)
            found = [pa.array(jump_hash(keys, n).astype(np.int32)) for n in (shards, shards + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "shard", "grown_shard"])

    return df.mapInArrow(released(run), "doc_id long, size long, text_crc32 long, shard int, grown_shard int")


def assign_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Only the id decides the shard.  A null text counts as no bytes (CRC 0), a null
    id as the key -1; repeated rows keep one slot each; an empty table gives no rows.  A
    text of any length counts whole.  Other columns are left alone.

    Slots are numbered in two levels, by hash bucket within the shard and by id
    within the bucket, so no task sees a whole shard.  Equal rows are counted
    before the shuffle and spread out again after it.
    """
    buckets = buckets or 4 * partitions(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = with_shards(sized, shards).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    # Both numberings read these rows, which are far smaller than the texts.
    counted = materialise(rows.groupBy("shard", "bucket", "doc_id", "size", "text_crc32", "grown_shard").agg(F.count("*").alias("copies")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy("shard", "bucket").agg(F.sum("copies").alias("held")).select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("slot", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(starts, ["shard", "bucket"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("start") + F.col("slot"), F.col("start") + F.col("slot") + F.col("copies") - 1)).alias("slot"),
        "grown_shard",
    )
