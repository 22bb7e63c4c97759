"""Sentiment by the true lists on written texts, and the consensus of labels by hand."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import sentiment

CASES = [
    ("Shares SURGE on record profit!", "STRONG_BUY", 3, 5 / 3),
    ("strong strong, (strong) growth.", "BUY", 2, 1.0),
    ("An efficient plan", "STRONG_BUY", 2, 1.5),
    ("crash and 'fraud' but growth", "SELL", 3, -1.0),
    ("bankruptcy; collapse", "STRONG_SELL", 2, -2.0),
    ("gain and loss, mixed", "HOLD", 2, 0.0),
    ("surged recorded profits", "HOLD", 0, 0.0),
    ("best-in-class ~market_leader~ $buy$", "STRONG_BUY", 3, 5 / 3),
    ("miss drop\tgain\n", "HOLD", 3, -1 / 3),
    ("", "HOLD", 0, 0.0),
    (None, "HOLD", 0, 0.0),
]


def test_levels_of_texts(spark):
    x = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(CASES)], "i int, text string")
    got = {r.i: r for r in sentiment.labelled(x).collect()}
    for i, (_, level, hits, score) in enumerate(CASES):
        assert (got[i].level, got[i].hits) == (level, hits) and math.isclose(got[i].score, score), CASES[i]


def test_consensus_by_hand(spark):
    rows = [("a", "STRONG_BUY", 1.0), ("a", "BUY", 0.5), ("a", "BUY", 0.0), ("b", "SELL", 2.0), ("c", "HOLD", 1.0), ("c", "STRONG_SELL", 3.0)]
    x = spark.createDataFrame(rows, "k string, level string, w double")
    got = {r.k: r for r in sentiment.consensus(x, ["k"], F.col("w")).collect()}
    mean = (2.0 + 0.5 + 0.05) / 1.55
    assert got["a"].score == round(mean, 3) and got["a"].level == "STRONG_BUY" and got["a"].buy == 2
    assert got["a"].confidence == round(min(0.95, 0.45 + mean * 0.28 + 2 / 3 * 0.2 + 1 / 1.55 * 0.18), 3)
    assert (got["b"].score, got["b"].level, got["b"].confidence) == (-1.0, "SELL", 0.95)
    assert (got["c"].score, got["c"].level, got["c"].n) == (-1.5, "SELL", 2)
    assert sentiment.consensus(x.limit(0), ["k"], F.col("w")).count() == 0
