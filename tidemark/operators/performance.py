"""Performance of return series, and the backtest as a set of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numeric import rounded
from tidemark.sources.market import by_date

RISK_FREE, YEAR = 0.04, 252.0


def sharpe_rounded(r: Column, rf: float = RISK_FREE) -> Column:
    """Annualised; population deviation; 0 for a constant series."""
    sd = F.stddev_pop(r)
    return F.when(sd < 1e-12, 0.0).otherwise(rounded(F.sqrt(F.lit(YEAR)) * (F.avg(r) - rf / YEAR) / F.greatest(sd, F.lit(1e-12))))


def sortino(r: Column, rf: float = RISK_FREE) -> Column:
    """Deviation of the negative excess returns around their own mean."""
    excess = r - rf / YEAR
    return F.sqrt(F.lit(YEAR)) * (F.avg(r) - rf / YEAR) / F.nullif(F.stddev_pop(F.when(excess < 0, excess)), F.lit(0.0))


def annual_pct(r: Column) -> Column:
    return (F.pow(F.exp(F.sum(F.log(1 + r))), YEAR / F.count(F.lit(1))) - 1) * 100


def with_drawdown(df: DataFrame, include_start: bool = True) -> DataFrame:
    """equity and dd_pct along each symbol; the peak starts at 1 with ``include_start``."""
    df = df.withColumn("equity", F.exp(F.sum(F.log(1 + F.col("ret"))).over(by_date())))
    peak = F.max("equity").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    peak = F.greatest(F.lit(1.0), peak) if include_start else peak
    return df.withColumn("dd_pct", (F.col("equity") - peak) / peak * 100)


def summary(df: DataFrame, keys: list[str]) -> DataFrame:
    r = F.col("ret")
    return df.groupBy(*keys).agg(
        F.count("*").alias("bars"), sharpe_rounded(r).alias("sharpe"), rounded(sortino(r)).alias("sortino"),
        rounded(F.min("dd_pct")).alias("max_drawdown_pct"), rounded(annual_pct(r)).alias("annual_pct"),
    )


def backtest(df: DataFrame, every: int, delay: int) -> DataFrame:
    """decided (on rebalance bars only) and exposure, which adopts a decision ``delay`` bars later.

    ``df`` has bars indexed by i of n and the wanted exposure ``want`` of each bar, known at
    its close.  Rebalance bars start at min(260, max(120, n / 3)).
    """
    start = F.expr("least(260, greatest(120, n div 3))")
    decided = df.withColumn("decided", F.when((F.col("i") >= start) & ((F.col("i") - start) % every == 0), F.col("want")))
    due = decided.withColumn("due", F.lag("decided", delay).over(by_date()))
    held = F.last("due", ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return due.withColumn("exposure", F.coalesce(held, F.lit(0.0))).drop("due")


def coverage_curve(df: DataFrame, shares: list[int], ties: list[str]) -> DataFrame:
    """coverage, n and accuracy of sign among the most confident shares of all rows.

    Rows are ranked in two levels: by confidence band (a share of the value range, counted
    first), then within the band, so no single task sorts everything.
    """
    bands = 64
    high = df.agg(F.max("confidence").alias("high"), F.count("*").alias("total"))
    row = high.first()  # two numbers
    top, total = (row["high"] or 1.0) or 1.0, row["total"]
    x = df.withColumn("band", F.least(F.floor(F.col("confidence") / top * bands).cast("int"), F.lit(bands - 1)))
    before = Window.partitionBy(F.lit(0)).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)  # at most `bands` rows
    sizes = x.groupBy("band").agg(F.count("*").alias("c")).select("band", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("confidence"), *ties))
    x = x.withColumn("r", rank).join(F.broadcast(sizes), "band").withColumn("r", F.col("r") + F.col("first"))
    hit = F.when(F.signum("score") == F.signum("fwd"), 1.0).otherwise(0.0)
    cells = F.filter(F.array(*[F.struct(F.lit(s).alias("coverage"), F.lit(max(1, total * s // 100)).alias("upto")) for s in shares]), lambda c: F.col("r") <= c["upto"])
    return x.select(F.explode(cells).alias("c"), hit.alias("hit")).groupBy("c.coverage").agg(F.count("*").alias("n"), rounded(F.avg("hit")).alias("accuracy"))
