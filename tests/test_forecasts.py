"""Forecasters and resampling tests against plain versions of their definitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.functions import forecast as fc
from tidemark.functions import resample as rs
from tidemark.plans import forecasting


def series(n: int = 330, seed: int = 1) -> pd.DataFrame:
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, len(fc.FEATURES)))
    x[:, 3] = 2.0  # a constant feature
    x[5, 1] = 40.0  # an outlier beyond the winsor limit
    frame = pd.DataFrame(x, columns=list(fc.FEATURES)).assign(symbol="A", i=np.arange(n), date=pd.date_range("2020-01-01", periods=n).date)
    frame["target"] = 0.01 * x[:, 0] + 0.02 * draw.normal(size=n)
    frame.loc[n - 5 :, "target"] = np.nan
    return frame


def plain(x: np.ndarray, y: np.ndarray, point: np.ndarray, alpha: float, penalty: float) -> tuple[float, float]:
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-9] = 1.0
    scale = lambda v: np.r_[1.0, np.clip((v - mean) / sd, -4, 4)]
    z, now = np.array([scale(v) for v in x]), scale(point)
    size = z.shape[1]
    # Ridge as least squares over rows that stand for the penalty.
    rows = np.sqrt(alpha) * np.eye(size)[1:]
    w = np.linalg.lstsq(np.r_[z, rows], np.r_[y, np.zeros(size - 1)], rcond=None)[0]
    v = np.zeros(size)
    for _ in range(300):
        p = [1 / (1 + np.exp(-max(-30.0, min(30.0, float(r @ v))))) for r in z]
        g = sum((a - (b > 0)) * r for a, b, r in zip(p, y, z, strict=True)) / len(z)
        v = v - 0.15 * (g + penalty * np.r_[0.0, v[1:]] / len(z))
    return float(now @ w), float(1 / (1 + np.exp(-(now @ v))))


@pytest.mark.parametrize("expanding", [False, True])
def test_walk_forward(expanding):
    frame = series()
    got = fc.walk_forward(frame, expanding=expanding)
    known = frame[frame["target"].notna()]
    x, y = known[list(fc.FEATURES)].to_numpy(), known["target"].to_numpy()
    assert got["i"].tolist() == list(range(len(known) - 120, len(known)))
    for row in got.iloc[[0, 1, 63, 119]].itertuples():
        first = 0 if expanding else max(0, row.i - 220)
        ridge, up = plain(x[first : row.i], y[first : row.i], x[row.i], 1.8, 1.0)
        assert (row.ridge, row.up) == pytest.approx((ridge, up), abs=1e-8)
        unsure = abs(ridge) < 0.3 * np.median(np.abs(y[first : row.i]))
        assert row.sign == (1 if unsure and up >= 0.6 else -1 if unsure and up <= 0.4 else 1 if ridge >= 0 else -1)
        vol = x[first : row.i, fc.FEATURES.index("sd10")]
        assert row.high_vol == (x[row.i, fc.FEATURES.index("sd10")] > vol.mean() + 1.5 * vol.std())


def test_no_forecast_uses_later_rows():
    frame = series()
    before = fc.walk_forward(frame).set_index("i")
    changed = frame.copy()
    changed.loc[300:324, [*fc.FEATURES, "target"]] = 9.0
    after = fc.walk_forward(changed).set_index("i")
    same = [i for i in before.index if i < 300]
    assert len(same) > 50 and np.allclose(before.loc[same, ["ridge", "up"]].astype(float), after.loc[same, ["ridge", "up"]].astype(float))


def test_short_series_have_no_forecasts():
    assert fc.walk_forward(series(60)).empty


def test_pooled(spark):
    frames = [series(300, seed).assign(symbol=s) for seed, s in ((1, "A"), (2, "B"))]
    table = spark.createDataFrame(pd.concat(frames)).withColumn("target", F.when(~F.isnan("target"), F.col("target")))
    got = forecasting.pooled(table, 50, 1.8).toPandas().set_index(["symbol", "date"])
    known = [f[f["target"].notna()].reset_index(drop=True) for f in frames]
    n = len(known[0])
    for at in (n - 1, n - 40, n - 120):
        x = np.concatenate([k[list(fc.FEATURES)].to_numpy()[at - 50 : at] for k in known])
        y = np.concatenate([k["target"].to_numpy()[at - 50 : at] for k in known])
        for k in known:
            want, _ = plain(x, y, k[list(fc.FEATURES)].to_numpy()[at], 1.8, 1.0)
            assert got.loc[(k["symbol"][at], k["date"][at]), "ridge"] == pytest.approx(want, abs=1e-8)


def test_macd_feature(spark):
    x = forecasting.m.indexed(spark, SMALL).withColumn("feature", forecasting.macd_feature()).select("symbol", "i", "close", "feature").toPandas()
    for _, part in x[x["symbol"].isin(["Brand#1", "Brand#12"])].groupby("symbol"):
        part = part.sort_values("i")
        closes = part["close"].to_numpy()
        for at in (3, 24, 25, 40, 99, 100, len(part) - 1):
            window = closes[max(0, at - 99) : at + 1]

            def average(values, n):
                out = np.full(len(values), values[:n].mean())
                for k in range(n, len(values)):
                    out[k] = 2 / (n + 1) * values[k] + (1 - 2 / (n + 1)) * out[k - 1]
                return out

            line = average(window, 12) - average(window, 26)
            want = 0.0 if len(window) < 26 else np.clip((line - average(line, 9))[-1] / window[-1], -0.1, 0.1) * 10
            assert part["feature"].iloc[at] == pytest.approx(want, abs=1e-9)


def test_har_knows_only_the_past():
    draw = np.random.default_rng(3)
    frame = pd.DataFrame({"symbol": "A", "i": np.arange(700), "ret": np.r_[np.nan, 0.02 * draw.normal(size=699)]})
    got = fc.har_forecasts(frame)
    changed = frame.copy()
    changed.loc[frame["i"] >= got["i"][2], "ret"] = 0.5
    assert np.allclose(got["har"][:3], fc.har_forecasts(changed)["har"][:3])
    cut, r = 500, frame["ret"].to_numpy()[1:]
    v = r**2
    rows = [[np.log(v[t]), np.log(v[t - 4 : t + 1].mean()), np.log(v[t - 21 : t + 1].mean()), 1.0] for t in range(22, cut)]
    goal = [np.log(v[t + 1 : t + 22].mean()) for t in range(22, cut - 21)]
    beta = np.linalg.lstsq(np.array(rows[: len(goal)]), np.array(goal), rcond=None)[0]
    assert got["har"][0] == pytest.approx(float(np.exp(np.array(rows[-1]) @ beta)), rel=1e-6)


def test_superior_ability_finds_a_good_model_only():
    draw = np.random.default_rng(5)
    null = 0.01 * draw.normal(size=(800, 20))
    good = null.copy()
    good[:, 7] += 0.0025
    for d, low, high in ((null, 0.05, 1.0), (good, 0.0, 0.05)):
        search = rs.Search(d, 10.0)
        observed, draws = search.observed(), np.array([search.draw([3, k]) for k in range(300)])
        p = [(draws[:, c] >= observed[c]).mean() for c in range(3)]
        assert low <= p[0] <= high and p[0] <= p[1] + 0.05
    assert rs.Search(good, 10.0).best == 7


def test_bootstrap_indices_are_blocks():
    lengths = []
    for k in range(50):
        at = fc.stationary_indices(400, 10.0, np.random.default_rng(k))
        assert at.min() >= 0 and at.max() < 400 and len(at) == 400
        lengths.append(400 / (1 + ((at[1:] - at[:-1]) % 400 != 1).sum()))
    assert 8 < np.mean(lengths) < 12.5


def test_ridge_walk_is_the_backtest_and_the_live_forecast():
    """One fit serves the walked forecast of a row and the live one where its window is known."""
    frame = series(330, 4)
    got = fc.ridge_walk(frame, 5).set_index("i")
    back = fc.walk_forward(frame)
    assert got["walk"].reindex(back["i"]).to_numpy() == pytest.approx(back["ridge"].to_numpy(), abs=1e-10)
    assert got["walk"].first_valid_index() == 90 and got["walk"].last_valid_index() == 324
    for at in (94, 150, 329):
        then = frame[: at + 1].copy()
        then.loc[at - 4 :, "target"] = np.nan  # not known at that row
        assert got["model"][at] == pytest.approx(fc.live(then)[0], abs=1e-10)
        again = fc.ridge_walk(then, 5).set_index("i")["model"]
        assert again.to_numpy() == pytest.approx(got["model"].loc[:at].to_numpy(), abs=1e-12, nan_ok=True)
    assert got["model"].first_valid_index() == 94
    assert fc.ridge_walk(frame[:50], 5)[["walk", "model"]].isna().all(axis=None) and len(fc.ridge_walk(frame[:3], 5)) == 3


def test_records_at_rebalance_points(spark):
    """At the newest bar the record is that of the live forecast; the calendar has one for each due bar with a past."""
    key = lambda x: x.sort_values("symbol").reset_index(drop=True)
    live, again = (key(x.toPandas()) for x in (forecasting.mdl_06_forecast(spark, SMALL), forecasting.rebalanced(spark, SMALL, "i = n - 1 and n >= 90")))
    pd.testing.assert_frame_equal(live, again[live.columns], atol=0.011)
    x = forecasting.mdl_06_rebalanced(spark, SMALL).toPandas()
    assert len(x) > len(live) and not x.duplicated(["symbol", "date"]).any() and x["return_pct"].abs().max() <= 6.5
    assert x.notna().all(axis=None) and x["trend"].isin(["bullish", "bearish", "sideways"]).all()
