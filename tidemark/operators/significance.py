"""Tests of means and forecasts on long tables: t tests, Diebold-Mariano, ranks for correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.distributions import t_two_sided


def diebold_mariano(df: DataFrame, by: list[str], order: list[str], loss_a: Column, loss_b: Column, horizon: int) -> DataFrame:
    """``by``, n, mean_a, mean_b, dm and p_value of equal expected loss; dm below 0 favours a.

    The variance takes horizon - 1 lags with Bartlett's weights, as forecasts of overlapping
    spans are correlated; dm has the small-sample correction and a t with n - 1 degrees of
    freedom.  Fewer than three rows: 0 and 1.  One sort by group.
    """
    whole, path = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(*order)
    x = df.withColumn("_a", loss_a.cast("double")).withColumn("_b", loss_b.cast("double")).withColumn("_c", F.col("_a") - F.col("_b"))
    x = x.withColumn("_c", F.col("_c") - F.avg("_c").over(whole))
    lags = [F.lag("_c", k).over(path).alias(f"_{k}") for k in range(1, horizon)]
    g = x.select(*by, "_a", "_b", "_c", *lags).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("_a").alias("mean_a"), F.avg("_b").alias("mean_b"), F.sum(F.col("_c") * F.col("_c")).alias("_0"), *(F.sum(F.col("_c") * F.col(f"_{k}")).alias(f"_{k}") for k in range(1, horizon))
    )
    n = F.col("n").cast("double")
    total = F.col("_0")
    for k in range(1, horizon):
        total = total + 2 * (1 - k / horizon) * F.coalesce(F.col(f"_{k}"), F.lit(0.0))
    plain = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(F.greatest(total / n, F.lit(1e-18)) / n)
    small = F.sqrt(F.greatest((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n, F.lit(1e-12)))
    g = g.withColumn("dm", F.when(n < 3, 0.0).otherwise(plain * small))
    return g.select(*by, "n", "mean_a", "mean_b", "dm", F.when(n < 3, 1.0).otherwise(t_two_sided(F.col("dm"), n - 1)).alias("p_value"))


def direction_losses(predicted: Column, actual: Column) -> tuple[Column, Column]:
    """0/1 losses of a forecast's direction and of always saying up."""
    return F.when(F.signum(predicted) == F.signum(actual), 0.0).otherwise(1.0), F.when(F.signum(actual) == 1, 0.0).otherwise(1.0)


def one_sample(x: str) -> tuple[Column, Column]:
    """(t, degrees of freedom) aggregates of the mean against 0; null if the values are all alike."""
    sd = F.stddev_samp(x)
    return F.avg(x) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.count(x)), F.count(x) - 1


def welch(a: str, b: str) -> tuple[Column, Column]:
    """(t, degrees of freedom) aggregates of the difference of two columns' means, nulls left out."""
    va, vb = F.var_samp(a) / F.count(a), F.var_samp(b) / F.count(b)
    both = F.nullif(va + vb, F.lit(0.0))
    return (F.avg(a) - F.avg(b)) / F.sqrt(both), both * both / (va * va / (F.count(a) - 1) + vb * vb / (F.count(b) - 1))


def with_average_rank(df: DataFrame, by: list[str], value: str, name: str, bands: int = 64) -> DataFrame:
    """``df`` with the rank of ``value`` among the rows of its group, equal values sharing the mean of their ranks.

    Values are counted first, so ties of any number are one row; the distinct ones are ranked in
    bands between quantiles, so no task sorts a whole group.
    """
    counted = df.groupBy(*by, value).agg(F.count("*").alias("_count"))
    cuts = counted.groupBy(*by).agg(F.percentile_approx(value, [k / bands for k in range(1, bands)]).alias("_cuts"))
    banded = counted.join(F.broadcast(cuts), by).withColumn("_band", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    # At most ``bands`` rows a group.
    sizes = banded.groupBy(*by, "_band").agg(F.sum("_count").alias("_rows"))
    ahead = Window.partitionBy(*by).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_band", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy(*by, "_band").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = banded.withColumn("_upto", F.sum("_count").over(within)).join(F.broadcast(sizes), [*by, "_band"])
    ranks = ranked.select(*by, value, (F.col("_ahead") + F.col("_upto") - (F.col("_count") - 1) / 2).alias(name))
    return df.join(ranks, [*by, value])
