"""Places in an order over a whole table, and what a cap keeps, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_place(df: DataFrame, key: str, within: str, rest: list[str], name: str = "place", bands: int = 64) -> DataFrame:
    """``df`` with its place (1: first) by ``key`` descending, then ``within`` and ``rest`` ascending.

    Rows are numbered in bands between quantiles of the numeric ``key``; a value that many
    rows share is itself a quantile and has bands of its own, one for each ``within``.  NaN
    comes first and null keys last.  Equal rows get places
    in any order.
    """
    cuts = df.agg(F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(key, [k / bands for k in range(1, bands)]), F.array().cast(df.select(F.array(key)).schema[0].dataType)))).alias("_cuts"))
    x = df.crossJoin(F.broadcast(cuts))  # one row
    shared = F.array_contains("_cuts", F.col(key)) | F.col(key).isNull()
    above = F.when(F.col(key).isNull(), bands).otherwise(F.size(F.filter("_cuts", lambda c: c > F.col(key))))
    x = x.withColumn("_band", above * 2 + F.when(shared, 0).otherwise(-1)).withColumn("_sub", F.when(shared, F.col(within))).drop("_cuts")
    order = Window.orderBy("_band", F.asc_nulls_first("_sub"))
    # Two rows a band at most, and one for each ``within`` where a value is shared.
    sizes = x.groupBy("_band", "_sub").agg(F.count("*").alias("_rows")).withColumn("_ahead", F.coalesce(F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    own = F.row_number().over(Window.partitionBy("_band", "_sub").orderBy(F.desc_nulls_last(key), F.asc_nulls_first(within), *[F.asc_nulls_first(c) for c in rest]))
    numbered, s = x.withColumn("_own", own), sizes.select(F.col("_band").alias("_b"), F.col("_sub").alias("_s"), "_ahead")
    return numbered.join(s, (F.col("_band") == F.col("_b")) & F.col("_sub").eqNullSafe(F.col("_s"))).select(*df.columns, (F.col("_ahead") + F.col("_own")).alias(name))


def with_cap(df: DataFrame, keys: list[str], order: list[Column], cap: int, name: str = "kept") -> DataFrame:
    """``df`` with whether a row is among the first ``cap`` by ``order``; ``keys`` tell rows apart and are not null.

    Each task keeps its own first ``cap``; only those meet, and only ``cap`` keys are told to all.
    """
    first = df.orderBy(*order).limit(cap).select(*keys, F.lit(True).alias(name))
    return df.drop(name).join(F.broadcast(first), keys, "left").fillna(False, [name])


def curated(lessons: DataFrame, keys: list[str], today: Column, stale_days: int = 90, cap: int = 200) -> DataFrame:
    """``lessons`` (times_seen, last_seen) with status: stale, over cap or active.

    A lesson is stale if it was not seen for ``stale_days`` for each sighting (four count at
    most); of the others the ``cap`` most seen stay, the newest first among equals, then by keys.
    """
    allowance = F.least(F.lit(4), F.greatest(F.lit(1), F.col("times_seen"))) * stale_days
    x = lessons.withColumn("_stale", F.datediff(today, "last_seen") > allowance)
    order = [F.col("_stale"), F.desc("times_seen"), F.desc("last_seen"), *map(F.col, keys)]
    x = with_cap(x, keys, order, cap, "_kept")
    return x.withColumn("status", F.when(F.col("_stale"), "stale").when(F.col("_kept"), "active").otherwise("over cap")).drop("_stale", "_kept")
