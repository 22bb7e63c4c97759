"""Screens, requests in words, market breadth and scorecards over quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import clip, ratio


def screen(quotes: DataFrame, text=None, pe_min=None, pe_max=None, cap_min=None, yield_min=None, beta_max=None, cross=None, direction=None) -> DataFrame:
    """Conjunction of the filters that are set; a null field fails every filter on it."""
    keep = F.lit(True)
    if text:
        keep &= F.contains(F.lower("symbol"), F.lit(text.lower()))
    for column, bound, below in (("pe_ratio", pe_min, False), ("pe_ratio", pe_max, True), ("market_cap", cap_min, False), ("dividend_yield", yield_min, False), ("beta", beta_max, True)):
        if bound is not None:
            keep &= (F.col(column) <= bound) if below else (F.col(column) >= bound)
    if cross:
        keep &= (F.col("ma50") > F.col("ma200")) if cross == "golden" else (F.col("ma50") <= F.col("ma200"))
    if direction:
        keep &= (F.col("change_pct") >= 0) if direction == "up" else (F.col("change_pct") < 0)
    return quotes.filter(keep)


def parse_requests(requests: DataFrame) -> DataFrame:
    """Filters named in the text ``ask``, null where it names none."""
    ask = F.lower("ask")
    number = lambda pattern: F.expr(f"try_cast(nullif(regexp_extract(lower(ask), '{pattern}', 1), '') as double)")
    return requests.select(
        "ask",
        number("(?:p/e|pe) (?:under|below) ([0-9.]+)").alias("pe_max"),
        F.coalesce(number("yield (?:above|over) ([0-9.]+)"), F.when(ask.contains("high dividend"), 3.0)).alias("yield_min"),
        F.when(ask.contains("large cap"), 1e10).alias("cap_min"),
        F.when(ask.contains("low beta"), 1.0).alias("beta_max"),
        F.when(ask.contains("golden cross"), "golden").when(ask.contains("death cross"), "death").alias("crossed"),
        F.when(ask.rlike("going up|gainers"), "up").when(ask.rlike("going down|losers"), "down").alias("direction"),
    )


def breadth(quotes: DataFrame) -> DataFrame:
    """Share of advancing symbols, mean move, regime, and the fear-greed index with its label."""
    span = F.col("hi52") - F.col("lo52")
    place = F.when(span > 0, clip(ratio(F.col("price") - F.col("lo52"), span), 0, 1))
    b = quotes.agg(F.count("*").alias("total"), F.count_if(F.col("change_pct") > 0).alias("advancing"), F.avg("change_pct").alias("move"), F.avg(place).alias("place"), F.count(place).alias("ranged"))
    b = b.withColumn("breadth", F.col("advancing") * 100.0 / F.greatest("total", F.lit(1))).withColumn("score", (F.col("breadth") - 50) / 50 + F.col("move") / 2)
    b = b.withColumn("regime", F.when(F.col("score") > 0.25, "risk-on").when(F.col("score") < -0.25, "risk-off").otherwise("neutral"))
    index = clip(F.col("breadth") * 0.5 + clip(50 + F.col("move") * 12, 0, 100) * 0.3 + F.when(F.col("ranged") >= 3, F.col("place") * 100).otherwise(50.0) * 0.2, 0, 100)
    b = b.withColumn("fear_greed", F.floor(index + 0.5))
    i = F.col("fear_greed")
    return b.withColumn("label", F.when(i < 25, "Extreme Fear").when(i < 45, "Fear").when(i <= 55, "Neutral").when(i <= 75, "Greed").otherwise("Extreme Greed"))


def ladder(value: Column, steps: list[tuple[float, int]], above: int) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for bound, score in steps:
        out = out.when(value < bound, score)
    return out.otherwise(above)


def scorecard(quotes: DataFrame, valuation: tuple, stability: tuple) -> DataFrame:
    """Four sub-scores and their weighted mean over those present (two at least)."""
    price, pe, y = F.col("price"), F.col("pe_ratio"), F.col("dividend_yield")
    above = lambda c: F.when(F.col(c).isNull(), 0).when(price >= F.col(c), 14).otherwise(-12)
    place = ratio(price - F.col("lo52"), F.col("hi52") - F.col("lo52")) * 100
    mom = F.lit(50) + above("ma50") + above("ma200") + F.when(F.col("ma50").isNull() | F.col("ma200").isNull(), 0).when(F.col("ma50") >= F.col("ma200"), 8).otherwise(-8)
    mom = mom + F.when(place.between(40, 88), 8).when(place > 88, 3).when(place < 20, -8).otherwise(0)
    dims = quotes.select(
        "symbol", "sector", F.when(pe <= 0, 28).otherwise(ladder(pe, *valuation)).alias("val"), mom.alias("mom"), ladder(F.col("beta"), *stability).alias("stab"),
        F.when(y >= 4, 95).when(y >= 2.5, 80).when(y >= 1, 60).when(y > 0, 42).when(y.isNotNull(), 20).alias("inc"),
    )
    weights = {"val": 0.3, "mom": 0.3, "stab": 0.2, "inc": 0.2}
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNull(), 0.0).otherwise(w) for c, w in weights.items()), F.lit(0.0))
    present = sum((F.col(c).isNotNull().cast("int") for c in weights), F.lit(0))
    card = dims.filter(present >= 2).withColumn("overall", F.floor(top / weight + 0.5))
    o = F.col("overall")
    return card.withColumn("band", F.when(o >= 75, "Strong").when(o >= 60, "Good").when(o >= 45, "Average").otherwise("Weak"))
