"""Significance of a strategy against its benchmark: bootstrap, data snooping, simulated power.

Replicates are rows that Spark deals out; each holds its own seed, so results do not
depend on the dealing.  The daily series (one row a date) are shared by all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import forecast as fc
from tidemark.functions import resample as rs
from tidemark.functions.numeric import rounded
from tidemark.operators import technical as ta
from tidemark.plans.registry import query
from tidemark.sources import market as m
from tidemark.sources.market import by_date

#: Replicates, mean block length in days, and tasks that they are dealt to.
REPLICATES, BLOCK, TASKS = 1000, 10.0, 8
LOOKBACKS = (5, 10, 20, 40, 60, 120)


def daily(spark, sf_dir):
    """date, r (equal weight of all symbols) and mret (the market); the calendar bounds the rows."""
    r = m.indexed(spark, sf_dir).filter("ret is not null").groupBy("date").agg(F.avg("ret").alias("r"))
    return r.join(m.market(spark, sf_dir), "date").select("date", "r", "mret").orderBy("date").toPandas()


def replicates(spark, draw, schema: str, n: int = REPLICATES):
    """One row for each seed from ``draw(seed)``."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([(int(seed), *draw(int(seed))) for seed in frame["id"]], columns=["replicate", *[c.split()[0] for c in schema.split(", ")]])

    return spark.range(n, numPartitions=TASKS).mapInPandas(run, f"replicate long, {schema}")


@query("sta_01_bootstrap_indices")
def sta_01_bootstrap_indices(spark, sf_dir):
    """Of each draw of 500 days: its blocks, their mean length and the different days in it."""

    def draw(seed):
        at = fc.stationary_indices(500, BLOCK, np.random.default_rng([7, seed]))
        blocks = 1 + int(((at[1:] - at[:-1]) % 500 != 1).sum())
        return blocks, 500 / blocks, len(set(at.tolist()))

    return replicates(spark, draw, "blocks long, mean_length double, days long", 200).withColumn("mean_length", rounded(F.col("mean_length")))


def tested(spark, a: np.ndarray, b: np.ndarray, seed: int = 11):
    """Observed difference of Sharpe ratios, its interval, and the two-sided p-value of recentred draws."""
    observed = rs.sharpe(a) - rs.sharpe(b)
    draws = replicates(spark, lambda k: (rs.difference_draw(a, b, BLOCK, [seed, k]),), "diff double")
    centre = draws.agg(F.avg("diff").alias("centre"))
    return draws.join(F.broadcast(centre)).agg(
        F.lit(len(a)).alias("days"), F.count("*").alias("replicates"), rounded(F.lit(observed), 4).alias("observed"), rounded(F.percentile("diff", F.lit(0.025)), 4).alias("low"), rounded(F.percentile("diff", F.lit(0.975)), 4).alias("high"),
        rounded(F.avg(F.when(F.abs(F.col("diff") - F.col("centre")) >= abs(observed), 1.0).otherwise(0.0)), 4).alias("p"))


@query("sta_02_bootstrap_difference")
def sta_02_bootstrap_difference(spark, sf_dir):
    """Equal weight against the market."""
    days = daily(spark, sf_dir)
    return tested(spark, days["r"].to_numpy(), days["mret"].to_numpy())


def outperformance(spark, sf_dir) -> np.ndarray:
    """Daily return of each momentum look-back, equal weight over symbols, less the market's (days, models)."""
    x = m.indexed(spark, sf_dir)
    for n in LOOKBACKS:
        x = x.withColumn(f"m{n}", ta.momentum(n)).withColumn(f"s{n}", F.when(F.lag(f"m{n}").over(by_date()) > 0, F.col("ret")).otherwise(0.0))
    r = x.filter(F.col("i") > max(LOOKBACKS)).groupBy("date").agg(*[F.avg(f"s{n}").alias(f"s{n}") for n in LOOKBACKS])
    days = r.join(m.market(spark, sf_dir), "date").orderBy("date").toPandas()  # one row a date
    return days[[f"s{n}" for n in LOOKBACKS]].to_numpy() - days[["mret"]].to_numpy()


def searched(spark, d: np.ndarray, seed: int = 999):
    """p-values of the best of several models: superior predictive ability, reality check, and as if it were alone."""
    search = rs.Search(d, BLOCK)
    observed = search.observed()
    draws = replicates(spark, lambda k: search.draw([seed, k]), "spa double, rc double, alone double")
    p = [rounded(F.avg(F.when(F.col(c) >= o, 1.0).otherwise(0.0)), 4).alias(f"p_{c}") for c, o in zip(("spa", "rc", "alone"), observed, strict=True)]
    return draws.agg(F.lit(search.best).alias("best"), rounded(F.lit(float(search.mean[search.best])), 8).alias("mean"), F.lit(d.shape[1]).alias("models"), F.lit(len(d)).alias("days"), *p)


@query("sta_05_superior_ability")
def sta_05_superior_ability(spark, sf_dir):
    return searched(spark, outperformance(spark, sf_dir))


@query("sta_07_simulated_power")
def sta_07_simulated_power(spark, sf_dir):
    """Share of simulated experiments whose interval leaves zero out, by true difference of Sharpe ratios."""
    x = None
    for k, effect in enumerate((0.0, 1.0, 4.0)):
        part = replicates(spark, lambda seed, k=k, effect=effect: rs.simulated_test(250, effect, 0.3, 0.75, 0.018, 60, BLOCK, [4242, k, seed]), "rejects boolean, width double", 80)
        part = part.agg(F.lit(effect).alias("effect"), F.count("*").alias("experiments"), rounded(F.avg(F.when(F.col("rejects"), 1.0).otherwise(0.0)), 4).alias("power"), rounded(F.avg("width"), 4).alias("width"))
        x = part if x is None else x.unionByName(part)
    return x


@query("sta_10_report")
def sta_10_report(spark, sf_dir):
    """Difference from the market of each symbol and of all together, with the verdict of its interval."""
    x = m.indexed(spark, sf_dir).filter("ret is not null").join(m.market(spark, sf_dir), "date").select("symbol", "date", "ret", "mret")
    whole = x.groupBy("date").agg(F.avg("ret").alias("ret"), F.first("mret").alias("mret")).select(F.lit("all").alias("symbol"), "date", "ret", "mret")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        a, b = frame["ret"].to_numpy(), frame["mret"].to_numpy()
        observed = rs.sharpe(a) - rs.sharpe(b)
        draws = np.array([rs.difference_draw(a, b, BLOCK, [31, k]) for k in range(REPLICATES // 5)])
        low, high = np.percentile(draws, [2.5, 97.5])
        p = float((np.abs(draws - draws.mean()) >= abs(observed)).mean())
        return pd.DataFrame({"symbol": [frame["symbol"].iloc[0]], "days": [len(a)], "observed": [observed], "low": [low], "high": [high], "p": [p]})

    found = x.unionByName(whole).groupBy("symbol").applyInPandas(run, "symbol string, days long, observed double, low double, high double, p double")
    verdict = F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("no difference")
    return found.select("symbol", "days", *[rounded(F.col(c), 4).alias(c) for c in ("observed", "low", "high", "p")], verdict.alias("verdict"))
