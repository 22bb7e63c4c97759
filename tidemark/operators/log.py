"""An append-only log: ids and seals by hash, idempotent appends, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decision_id() -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.date_format("as_of", "yyyy-MM-dd"), "symbol", "arm", F.col("horizon").cast("string")), 256), 1, 16)


def seal() -> Column:
    return F.sha2(F.concat_ws("|", "decision_id", "direction"), 256)


def sealed(df: DataFrame) -> DataFrame:
    return df.withColumn("decision_id", decision_id()).withColumn("seal", seal())


def new_rows(df: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the store does not hold, once each."""
    return df.dropDuplicates(key).join(held.select(*key), key, "left_anti")


def integrity(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col("seal") != seal()).alias("broken"), (F.count("*") - F.count_distinct("decision_id")).alias("duplicates"))
