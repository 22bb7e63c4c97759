"""Tails against published values and exact sums; properties of the forecast comparison; ranks against plain ones."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import distributions as dist
from tidemark.operators import significance as sig

# Two-sided points of Student's t from published tables (df, t, p).
POINTS = [(1, 12.7062047364, 0.05), (2, 4.30265272991, 0.05), (5, 2.57058183661, 0.05), (10, 2.22813885196, 0.05), (10, 3.16927267262, 0.01), (30, 2.04227245630, 0.05), (30, 2.74999565357, 0.01), (100, 1.98397151845, 0.05), (1000, 1.96233907888, 0.05), (4, 1.53320627406, 0.2)]


def test_t_tails_equal_tables(spark):
    got = spark.createDataFrame([(float(v), t, p) for v, t, p in POINTS], "v double, t double, want double").select("want", dist.t_two_sided(F.col("t"), F.col("v")).alias("p"), dist.t_two_sided(-F.col("t"), F.col("v")).alias("q")).collect()
    for r in got:
        assert math.isclose(r.p, r.want, abs_tol=1e-9) and r.p == r.q


def test_t_tails_at_the_ends(spark):
    rows = [(0.0, 7.0), (1e-14, 7.0), (60.0, 3.0), (1e6, 50.0), (2.0, 2.5), (1.96, 1e6)]
    got = [r.p for r in spark.createDataFrame(rows, "t double, v double").select(dist.t_two_sided(F.col("t"), F.col("v")).alias("p")).collect()]
    assert got[:2] == [1.0, 1.0] and 0 < got[2] < 1.1e-5 and got[3] < 1e-200
    # Two and a half degrees lie between two and three; a million is the normal.
    two, three = 1 - 2 / math.sqrt(2 + 4), 1 - 2 / math.pi * (math.atan(2 / math.sqrt(3)) + math.sqrt(3) * 2 / 7)
    assert three < got[4] < two and math.isclose(got[5], math.erfc(1.96 / math.sqrt(2)), abs_tol=1e-6)


def test_binomial_equals_exact_sums(spark):
    pairs = [(k, n) for n in (1, 2, 5, 10, 37, 200) for k in range(0, n + 1, max(1, n // 9))] + [(2600, 5003), (400, 1000)]
    got = spark.createDataFrame(pairs, "k long, n long").select("k", "n", dist.binomial_two_sided(F.col("k"), F.col("n")).alias("p")).collect()
    for r in got:
        far = max(r.k, r.n - r.k)
        term, total = math.comb(r.n, far), 0
        for j in range(far, r.n + 1):
            total, term = total + term, term * (r.n - j) // (j + 1)
        want = 1.0 if 2 * far == r.n else min(1.0, 2 * total / 2**r.n)
        assert math.isclose(r.p, want, rel_tol=1e-8, abs_tol=1e-12), r


def compare(spark, a, b, horizon=1):
    frame = spark.createDataFrame(pd.DataFrame({"g": "x", "i": range(len(a)), "a": np.asarray(a, float), "b": np.asarray(b, float)}))
    return sig.diebold_mariano(frame, ["g"], ["i"], F.col("a"), F.col("b"), horizon).first()


def plain_dm(a, b, h):
    d = np.asarray(a) - np.asarray(b)
    n, c = len(d), d - d.mean()
    total = c @ c / n + sum(2 * (1 - k / h) * (c[k:] @ c[:-k]) / n for k in range(1, h))
    return d.mean() / np.sqrt(max(total, 1e-18) / n) * np.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)


@pytest.mark.parametrize("h", [1, 5, 21])
def test_comparison_equals_the_formula(spark, h):
    draw = np.random.default_rng(h)
    a, b = draw.random(300).cumsum() % 1, draw.random(300)
    got = compare(spark, a, b, h)
    assert math.isclose(got.dm, plain_dm(a, b, h), rel_tol=1e-9) and got.n == 300


def test_properties_of_the_comparison(spark):
    draw = np.random.default_rng(8)
    same = draw.random(400)
    got = compare(spark, same, same)
    assert got.p_value > 0.99 and abs(got.dm) < 1e-9
    good, bad = draw.random(500) * 0.5, draw.random(500) * 0.5 + 0.3
    got = compare(spark, good, bad)
    assert got.dm < 0 and got.p_value < 0.01
    # Overlapping spans make the same losses less telling.
    walk = np.convolve(draw.normal(0.15, 1, 620), np.ones(21) / 21, "valid")
    short, long = compare(spark, walk, np.zeros(len(walk)), 1), compare(spark, walk, np.zeros(len(walk)), 21)
    assert abs(long.dm) < abs(short.dm) and long.p_value > short.p_value
    few = compare(spark, [1.0, 2.0], [0.0, 0.0])
    assert (few.dm, few.p_value) == (0.0, 1.0)


def test_direction_losses_tell_skill_from_drift(spark):
    draw = np.random.default_rng(14)
    actual = np.where(draw.random(2000) < 0.53, 1.0, -1.0)
    coin, skilled = np.where(draw.random(2000) < 0.5, 1.0, -1.0), np.where(draw.random(2000) < 0.65, actual, -actual)
    for predicted, skill in ((coin, False), (skilled, True)):
        frame = spark.createDataFrame(pd.DataFrame({"g": "x", "i": range(2000), "p": predicted, "y": actual}))
        got = sig.diebold_mariano(frame, ["g"], ["i"], *sig.direction_losses(F.col("p"), F.col("y")), horizon=1).first()
        assert (got.dm < 0 and got.p_value < 0.01) == skill


def test_one_sample_and_welch(spark):
    draw = np.random.default_rng(3)
    a, b = draw.normal(0.2, 1, 40), draw.normal(0, 3, 25)
    frame = spark.createDataFrame(pd.DataFrame({"a": pd.Series(a), "b": pd.Series(b)}).astype(object).where(lambda x: x.notna(), None), "a double, b double")
    (t, df), (w, wdf) = sig.one_sample("a"), sig.welch("a", "b")
    got = frame.agg(t.alias("t"), df.alias("df"), w.alias("w"), wdf.alias("wdf")).first()
    va, vb = a.var(ddof=1) / 40, b.var(ddof=1) / 25
    assert math.isclose(got.t, a.mean() / a.std(ddof=1) * math.sqrt(40)) and got.df == 39
    assert math.isclose(got.w, (a.mean() - b.mean()) / math.sqrt(va + vb)) and math.isclose(got.wdf, (va + vb) ** 2 / (va**2 / 39 + vb**2 / 24))
    alike = spark.createDataFrame([(1.0,), (1.0,)], "a double").agg(t.alias("t")).first()
    assert alike.t is None


@pytest.mark.parametrize("bands", [2, 64])
def test_average_ranks(spark, bands):
    draw = np.random.default_rng(bands)
    frame = pd.DataFrame({"g": draw.integers(0, 3, 900), "v": np.where(draw.random(900) < 0.4, 5.0, draw.integers(-30, 30, 900) / 4)})
    got = sig.with_average_rank(spark.createDataFrame(frame), ["g"], "v", "r", bands).toPandas()
    assert len(got) == 900
    want = frame.assign(r=frame.groupby("g")["v"].rank())
    assert sorted(map(tuple, got[["g", "v", "r"]].values)) == sorted(map(tuple, want[["g", "v", "r"]].values))
