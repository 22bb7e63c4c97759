"""Window features of bars: averages, oscillators, bands, volatility, regimes.

All functions take bars indexed by ``i`` within each symbol (see sources.market) and add
columns; everything is a window over one specification, so a chain costs one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numeric import clip
from tidemark.functions.recursion import indicators
from tidemark.sources.market import by_date, last

def all_bars():
    return Window.partitionBy("symbol")


def warm(value: Column, n: int) -> Column:
    """Null until n bars are there."""
    return F.when(F.col("i") >= n - 1, value)


def sma(n: int, column: str = "close") -> Column:
    return warm(F.avg(column).over(last(n)), n)


def momentum(n: int) -> Column:
    before = F.lag("close", n).over(by_date())
    return F.col("close") / before - 1


def momentum_12_1() -> Column:
    """From 251 to 21 bars ago, once more than 253 bars are there."""
    return F.when(F.col("i") >= 253, F.lag("close", 21).over(by_date()) / F.lag("close", 251).over(by_date()) - 1)


def forward_return(h: int) -> Column:
    return F.lead("close", h).over(by_date()) / F.col("close") - 1


def bollinger(n: int = 20, width: float = 2.0) -> tuple[Column, Column, Column]:
    mid, sd = sma(n), warm(F.stddev_pop("close").over(last(n)), n)
    return mid, mid + width * sd, mid - width * sd


def percent_b(n: int = 20) -> Column:
    mean, sd = F.avg("close").over(last(n)), F.stddev_pop("close").over(last(n))
    return F.when(F.col("i") < n - 1, 0.0).when(sd < 1e-9, 0.0).otherwise(clip((F.col("close") - mean) / F.greatest(2 * sd, F.lit(1e-12)), -2, 2))


def rsi_simple(n: int = 14) -> Column:
    """Cutler's form on price changes; 100 without losses."""
    change = F.col("close") - F.lag("close").over(by_date())
    gain, loss = (F.avg(F.greatest(x, F.lit(0.0))).over(last(n)) for x in (F.col("change"), -F.col("change")))
    return F.when(F.col("i") >= n, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.greatest(loss, F.lit(1e-300)))))


def with_change(df: DataFrame) -> DataFrame:
    return df.withColumn("change", F.col("close") - F.lag("close").over(by_date()))


def rsi_returns(n: int = 14) -> Column:
    """On percent returns, scaled to [-1, 1], with a guarded denominator."""
    up, down = (F.avg(F.greatest(x, F.lit(0.0))).over(last(n)) for x in (F.col("ret"), -F.col("ret")))
    return F.when(F.col("i") >= n, (up / (up + down + 1e-9) - 0.5) * 2)


def realised_vol(n: int, inclusive: bool = True) -> Column:
    """Population deviation of returns; without ``inclusive`` the frame ends a bar earlier."""
    frame = last(n) if inclusive else by_date().rowsBetween(-n, -1)
    return F.when(F.col("i") >= (n if inclusive else n + 1), F.stddev_pop("ret").over(frame))


def volume_log_ratio(n: int = 20) -> Column:
    mean = F.avg("volume").over(last(n))
    return F.when((F.count("volume").over(last(n)) == n) & (mean > 0) & (F.col("volume") > 0), clip(F.log(F.col("volume") / F.greatest(mean, F.lit(1e-9))), -1.5, 1.5)).otherwise(0.0)


def range_features(n: int = 20) -> tuple[Column, Column]:
    high, low = F.max("close").over(last(n)), F.min("close").over(last(n))
    return F.col("close") / high - 1, F.when(high > low, (F.col("close") - low) / F.greatest(high - low, F.lit(1e-9)) - 0.5).otherwise(0.0)


def drawdown() -> Column:
    peak = F.max("close").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return F.col("close") / peak - 1


def true_range() -> Column:
    before = F.lag("close").over(by_date())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


RECURSIVE = "symbol string, date date, i int, close double, ema12 double, ema26 double, ema_flat double, rsi double, macd double, signal double, hist double, ewma_var double"


def recursive_indicators(bars: DataFrame) -> DataFrame:
    """EMA (null and flat warm-up), Wilder RSI, MACD and EWMA variance of each bar.

    These recursions are ordered folds; one symbol's bars form one group, which the
    calendar bounds.
    """
    return bars.select("symbol", "date", "i", "close").groupBy("symbol").applyInPandas(indicators, RECURSIVE)
