"""Bars and sessions of tick streams; late ticks beyond the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded


def tumbling_bars(ticks: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    order = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", late).groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("ticks"))
    return bars.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "ticks")


def session_stats(ticks: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    sessions = ticks.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("ticks"), F.sum("value").alias("total"))
    return sessions.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "ticks", rounded(F.col("total")).alias("total"))
