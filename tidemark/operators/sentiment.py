"""Sentiment of texts by weighted word lists, and what the labels of many texts say together.

The lists are parameters: (weight, words) pairs; a word may stand in several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lexicon import SENTIMENT, SIGNS
from tidemark.functions.numeric import rounded

Lists = tuple[tuple[int, list[str]], ...]
# Levels by the least score, and the value of each level.
LEVELS = ((1.5, "STRONG_BUY"), (0.5, "BUY"), (-0.5, "HOLD"), (-1.5, "SELL"))
VALUES = {"STRONG_BUY": 2.0, "BUY": 1.0, "HOLD": 0.0, "SELL": -1.0, "STRONG_SELL": -2.0}
LEAST_WEIGHT = 0.05


def level(score: Column) -> Column:
    out = F.when(score >= LEVELS[0][0], LEVELS[0][1])
    for least, name in LEVELS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("STRONG_SELL")


def tokens(text: Column) -> Column:
    """The distinct tokens of a text, in lower case and without signs at their ends."""
    return F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: F.lower(F.btrim(t, F.lit(SIGNS)))))


def labelled(df: DataFrame, text: str = "text", lists: Lists = SENTIMENT) -> DataFrame:
    """``df`` with hits, score (their mean weight, 0 without hits) and level of each text; null and empty texts hold no word."""
    found = [F.size(F.array_intersect("_tokens", F.array(*map(F.lit, dict.fromkeys(words))))) for _, words in lists]
    x = df.withColumn("_tokens", tokens(F.col(text))).withColumn("_found", F.array(*found)).drop("_tokens")
    weights = F.array(*(F.lit(float(w)) for w, _ in lists))
    total = F.aggregate(F.zip_with("_found", weights, lambda n, w: n * w), F.lit(0.0), lambda a, v: a + v)
    x = x.withColumn("hits", F.aggregate("_found", F.lit(0), lambda a, n: a + n)).withColumn("score", F.when(F.col("hits") > 0, total / F.col("hits")).otherwise(0.0))
    return x.withColumn("level", level(F.col("score"))).drop("_found")


def consensus(df: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """``by``, n, the count of each level, and score, level and confidence of all labels together.

    The score is the weighted mean of the levels' values (weights at least 0.05); confidence grows
    with its size, with the share of the commonest level and with the share of the heaviest text.
    """
    values = F.create_map(*(F.lit(x) for pair in VALUES.items() for x in pair))
    x = df.withColumn("_weight", F.greatest(weight.cast("double"), F.lit(LEAST_WEIGHT))).withColumn("_value", values[F.col("level")])
    counts = {name: F.count_if(F.col("level") == name).alias(name.lower()) for name in VALUES}
    g = x.groupBy(*by).agg(F.count("*").alias("n"), *counts.values(), F.sum("_weight").alias("_total"), F.max("_weight").alias("_most"), F.sum(F.col("_value") * F.col("_weight")).alias("_sum"))
    names = [c.lower() for c in VALUES]
    mean = F.col("_sum") / F.greatest("_total", F.lit(1e-9))
    g = g.withColumn("_mean", mean).withColumn("_agree", F.greatest(*names) / F.col("n")).withColumn("_heavy", F.col("_most") / F.greatest("_total", F.lit(1e-9)))
    sure = F.least(F.lit(0.95), 0.45 + F.abs("_mean") * 0.28 + F.col("_agree") * 0.2 + F.col("_heavy") * 0.18)
    return g.select(*by, "n", *names, rounded(F.col("_mean"), 3).alias("score"), level(F.col("_mean")).alias("level"), rounded(sure, 3).alias("confidence"))
