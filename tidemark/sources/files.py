"""Readers of vendor files, and the cleaning that all of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Header names that vendors use for each field, in lower case.
HEADERS = {"date": ("date", "datetime", "timestamp"), "close": ("close", "close/last", "adj close"), "volume": ("volume", "vol")}


def find_column(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The column with one of these names, whatever its case and outer spaces; the first name that is there wins."""
    known = {c.strip().lower(): c for c in reversed(df.columns)}
    return next((known[n] for n in names if n in known), None)


def clean_prices(raw: DataFrame, *keep: str) -> DataFrame:
    """date, close and volume of rows of strings, with the columns ``keep``.

    Dollar signs and commas go; rows without a date or a close that parses go too, and
    with them second header rows.  A missing volume column, or a bad volume, is null.
    """
    at = {field: find_column(raw, names) for field, names in HEADERS.items()}
    if at["date"] is None or at["close"] is None:
        raise ValueError(f"no date or close among {raw.columns}")
    number = lambda c: F.regexp_replace(F.trim(F.col(f"`{c}`")), "[$,]", "").try_cast("double")
    day = F.trim(F.col(f"`{at['date']}`"))
    date = F.coalesce(day.try_cast("date"), F.try_to_timestamp(day, F.lit("M/d/yyyy")).cast("date"))
    volume = number(at["volume"]) if at["volume"] else F.lit(None).cast("double")
    return raw.select(*keep, date.alias("date"), number(at["close"]).alias("close"), volume.alias("volume")).dropna(subset=["date", "close"])


def vendor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily prices of CSV files with any of the known headers, quoted numbers and second header rows."""
    return clean_prices(spark.read.csv(path, header=True))


def phrase_bank(spark: SparkSession, path: str) -> DataFrame:
    """label and sentence of a Latin-1 file whose records end in a bare CR; the first comma parts the two."""
    lines = spark.read.option("lineSep", "\r").option("encoding", "ISO-8859-1").csv(path, sep="\x01", quote="").toDF("value")
    parts = F.split("value", ",", 2)
    return lines.filter(F.size(parts) == 2).select(F.trim(parts[0]).alias("label"), F.trim(F.btrim(F.trim(parts[1]), F.lit('"'))).alias("sentence"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
