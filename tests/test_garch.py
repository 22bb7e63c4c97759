"""GARCH by likelihood, and manifests by content."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import garch
from tidemark.operators import manifest
from tidemark.sources import shared


def simulated(n: int, omega: float, alpha: float, beta: float, seed: int) -> np.ndarray:
    draw, variance, out = np.random.default_rng(seed), omega / (1 - alpha - beta), []
    for _ in range(n):
        out.append(draw.normal() * variance**0.5)
        variance = omega + alpha * out[-1] ** 2 + beta * variance
    return np.array(out)


@pytest.mark.parametrize("alpha,beta", [(0.08, 0.90), (0.2, 0.6)])
def test_parameters_are_recovered_and_no_grid_is_likelier(alpha, beta):
    r = simulated(5000, 4e-6, alpha, beta, 1)
    params, total, _, done = garch.fit(r, np.array([2500, 5000]))
    assert done.all() and abs(params[1, 1] - alpha) < 0.04 and abs(params[2, 1] - beta) < 0.08
    square = (r * 100) ** 2
    for a in np.linspace(alpha * 0.6, alpha * 1.4, 4):
        for b in np.linspace(beta - 0.1, min(beta + 0.1, 0.999 - a), 4):
            for level in (0.7, 1.0, 1.4):
                grid = np.array([[square.mean() * level * (1 - a - b)], [a], [b]])
                assert garch.likelihood(square, np.array([5000]), grid)[0][0] <= total[1] + 1e-3


def test_slopes_equal_differences():
    square, cuts, point = (simulated(400, 1e-5, 0.1, 0.8, 2) * 100) ** 2, np.array([150, 400]), np.array([[0.1, 0.2], [0.1, 0.05], [0.8, 0.9]])
    _, _, slope, _ = garch.likelihood(square, cuts, point, True)
    for k in range(3):
        step = np.zeros((3, 2))
        step[k] = 1e-6
        found = (garch.likelihood(square, cuts, point + step)[0] - garch.likelihood(square, cuts, point - step)[0]) / 2e-6
        assert np.allclose(found, slope[k], rtol=1e-4)


def test_forecasts_know_only_the_past_and_fall_back():
    r = simulated(700, 4e-6, 0.1, 0.85, 3)
    frame = pd.DataFrame({"symbol": "S", "i": range(700), "ret": r})
    got = garch.garch_forecasts(frame)
    changed = frame.assign(ret=np.where(frame["i"] >= 542, 0.09, frame["ret"]))
    assert np.allclose(got["garch"][:3], garch.garch_forecasts(changed)["garch"][:3])
    flat = garch.garch_forecasts(frame.assign(ret=0.01))
    assert not flat["converged"].any() and np.allclose(flat["garch"], flat["rw"])
    assert garch.garch_forecasts(frame[:400]).empty
    v = r[:22].var()
    for x in r[22:500]:
        v = 0.94 * v + 0.06 * x * x
    assert got["ewma"][0] == pytest.approx(v) and got["rw"][0] == pytest.approx(r[479:500].var())


def test_digests_see_a_cent_but_not_the_partitioning(spark):
    rows = [(f"S{i % 3}", i, 100.0 + i, None if i % 7 else "x") for i in range(60)]
    x = spark.createDataFrame(rows, "symbol string, i long, close double, note string")
    columns = [F.col("i"), F.floor(F.col("close") * 100), F.col("note")]
    now = manifest.digests(x, ["symbol"], columns)
    again = manifest.digests(x.repartition(7, "i").orderBy(F.rand(3)), ["symbol"], columns)
    assert {r.status for r in manifest.compared(now, again, "symbol").collect()} == {"ok"}
    cent = x.withColumn("close", F.when(F.col("i") == 4, F.col("close") + 0.01).otherwise(F.col("close"))).filter("symbol <> 'S2'")
    cent = cent.union(spark.createDataFrame([("S9", 1, 1.0, None)], x.schema))
    got = {r.symbol: r.status for r in manifest.compared(now, manifest.digests(cent, ["symbol"], columns), "symbol").collect()}
    assert got == {"S0": "ok", "S1": "mismatch", "S2": "new", "S9": "missing"}
    swapped = x.withColumn("i", F.when(F.col("i") == 0, 3).when(F.col("i") == 3, 0).otherwise(F.col("i")))
    assert {r.status for r in manifest.compared(now, manifest.digests(swapped, ["symbol"], columns), "symbol").filter("symbol = 'S0'").collect()} == {"mismatch"}


def test_file_digests(spark):
    path = shared.folder(spark)
    spark.createDataFrame([("a", 1)], "k string, v int").coalesce(1).write.csv(f"{path}/one")
    spark.createDataFrame([("a", 1)], "k string, v int").coalesce(1).write.csv(f"{path}/two")
    spark.createDataFrame([("a", 2)], "k string, v int").coalesce(1).write.csv(f"{path}/three")
    got = manifest.file_digests(spark, path, "*.csv").collect()
    assert len(got) == 3 and len({r.digest for r in got}) == 2 and {r.bytes for r in got} == {4}
