"""Queries over files as vendors send them: each writes such files to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources import shared
from tidemark.sources.files import json_lines, phrase_bank, vendor_csv
from tidemark.sources.market import BARS_SQL, bars, table


@query("src_02_header_names", f"with {BARS_SQL} select date, close, volume from bars")
def src_02_header_names(spark, sf_dir):
    """Headers in any case, with spaces around them, are found; quoted money and counts become numbers."""
    path = shared.folder(spark)
    b = bars(spark, sf_dir).select(F.date_format("date", "MM/dd/yyyy").alias(" DATE "), F.concat(F.lit("$"), F.format_number("close", 4)).alias("Close/Last"), F.format_number("volume", 1).alias(" Volume"))
    b.write.option("header", True).csv(path)
    return vendor_csv(spark, path)


@query("src_03_second_header", f"with {BARS_SQL} select date, close, volume from bars")
def src_03_second_header(spark, sf_dir):
    """Files that carry the ticker in rows of their own below the header."""
    path = shared.folder(spark)
    b = bars(spark, sf_dir).select(F.col("date").cast("string").alias("Date"), F.col("close").cast("string").alias("Close"), F.col("volume").cast("string").alias("Volume"))
    extra = spark.createDataFrame([("Ticker", "ACME", "ACME"), ("Date", None, None)], "Date string, Close string, Volume string")
    extra.unionByName(b).write.option("header", True).csv(path)
    return vendor_csv(spark, path)


@query("src_20_phrase_bank", "select lang as label, 'É ' || source || ', ' || doc_id as sentence from documents where lang is not null")
def src_20_phrase_bank(spark, sf_dir):
    """Latin-1 records that end in a bare carriage return; only the first comma parts label and sentence."""
    path = shared.folder(spark)
    lines = table(spark, sf_dir, "documents").filter("lang is not null").select(F.concat_ws("", "lang", F.lit(",É "), "source", F.lit(", "), F.col("doc_id").cast("string")).alias("value"))
    lines.write.option("lineSep", "\r").option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").csv(path)
    return phrase_bank(spark, path)


@query("src_21_json_lines", "select event_id, value from events where event_id % 10 <> 3")
def src_21_json_lines(spark, sf_dir):
    """A log of which every tenth line was cut off in the middle."""
    path = shared.folder(spark)
    line = F.to_json(F.struct("event_id", "value"))
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 3, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    return json_lines(spark, path, "event_id long, value double")
