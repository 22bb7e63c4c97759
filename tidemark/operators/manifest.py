"""Manifests of tables and files by their contents: digests, and what is new, missing or changed against a recorded one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _half(place: int) -> Column:
    """Fifteen hexadecimal digits of the row's hash as a number."""
    return F.conv(F.substring("_hash", place, 15), 16, 10).cast("decimal(38,0)")


def digests(df: DataFrame, by: list[str], columns: list[Column], facts: dict[str, Column] | None = None) -> DataFrame:
    """``by``, rows, digest and the aggregates ``facts`` of each group.

    The digest is made of the number of rows and two sums of parts of each row's SHA-256, so it
    is the same however rows are ordered or dealt; any changed value changes it.  Nulls count as
    the word null.
    """
    row = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("null")) for c in columns))
    x = df.withColumn("_hash", F.sha2(row.cast("binary"), 256))
    sums = x.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(_half(1)).alias("_a"), F.sum(_half(17)).alias("_b"), *(v.alias(k) for k, v in (facts or {}).items()))
    digest = F.sha2(F.concat_ws("|", F.col("rows").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string")).cast("binary"), 256)
    return sums.select(*by, "rows", digest.alias("digest"), *(facts or {}))


def compared(now: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """``now`` with a status against the record: ok, mismatch or new; and the recorded keys that are missing."""
    was = recorded.select(F.col(key).alias("_key"), F.col("digest").alias("_digest"))
    both = now.join(was, F.col(key) == F.col("_key"), "full_outer")
    status = F.when(F.col("_key").isNull(), "new").when(F.col(key).isNull(), "missing").when(F.col("digest") != F.col("_digest"), "mismatch").otherwise("ok")
    return both.select(F.coalesce(key, "_key").alias(key), *(c for c in now.columns if c != key), status.alias("status"))


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, bytes and SHA-256 of each file below a folder; a file is read whole by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))
