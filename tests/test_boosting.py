"""Boosted trees against a plain version that tries every split of every node."""

from __future__ import annotations

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.test_forecasts import series
from tidemark.functions import boosting as bo
from tidemark.functions import forecast as fc
from tidemark.plans import forecasting


def plain_tree(x, slope, curve, rows, point, level):
    """(value by row, value at the point) of one tree, split by split."""
    here, best = -slope[rows].sum() ** 2 / curve[rows].sum(), None
    if level < bo.LEVELS:
        for f in range(x.shape[1]):
            steps = np.unique(x[:, f])
            for middle in (steps[:-1] + steps[1:]) / 2:
                sides = rows[x[rows, f] <= middle], rows[x[rows, f] > middle]
                if min(map(len, sides)) < bo.LEAST_ROWS or min(curve[s].sum() for s in sides) < bo.LEAST_CURVE:
                    continue
                gain = here + sum(slope[s].sum() ** 2 / curve[s].sum() for s in sides)
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                    best = gain, f, middle, sides
    out = np.zeros(len(x))
    if best is None:
        value = -bo.STEP * slope[rows].sum() / curve[rows].sum()
        out[rows] = value
        return out, value
    _, f, middle, sides = best
    branches = [plain_tree(x, slope, curve, s, point, level + 1) for s in sides]
    return branches[0][0] + branches[1][0], branches[int(point[f] > middle)][1]


def plain_odds(x, y, point):
    share = (y > 0).mean()
    now = np.log(share / (1 - share))
    odds = np.full(len(x), now)
    for _ in range(bo.TREES):
        p = 1 / (1 + np.exp(-odds))
        step, at = plain_tree(x, p - (y > 0), p * (1 - p), np.arange(len(x)), point, 0)
        odds, now = odds + step, now + at
    return now


@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    monkeypatch.setattr(bo, "TREES", 6)


def test_walked_forward_as_by_every_split():
    frame = series(200, 3)
    got = bo.boosted_walk(frame, 2)
    known = frame[frame["target"].notna()]
    x, y = known[list(fc.FEATURES)].to_numpy(), known["target"].to_numpy()
    assert [len(bo.boosted_walk(frame, k)) for k in range(bo.parts())] == [40, 40, 25]  # 90 rows come before the first
    for row in got.iloc[[0, 11, 24]].itertuples():
        mean, sd = x[: row.i].mean(axis=0), x[: row.i].std(axis=0)
        scale = lambda v: np.clip((v - mean) / np.where(sd < 1e-9, 1.0, sd), -4, 4)
        want = plain_odds(scale(x[: row.i]), y[: row.i], scale(x[row.i]))
        assert row.up == pytest.approx(1 / (1 + np.exp(-want)), abs=1e-9) and row.actual == y[row.i]


def test_later_rows_are_not_used():
    frame = series(330, 5)
    base = bo.boosted_walk(frame, 1).set_index("i")["up"]
    at = base.index[10]
    later = frame.copy()
    later.loc[later["i"] > at, list(fc.FEATURES)] *= -3.0
    later.loc[later["i"] >= at, "target"] *= -1.0
    changed = bo.boosted_walk(later, 1).set_index("i")["up"]
    assert (changed.loc[:at] == base.loc[:at]).all() and (changed.loc[at + 1 :] != base.loc[at + 1 :]).any()


def test_ties_one_class_and_few_rows():
    """Equal values are never parted; one class, or fewer rows than the least, gives no forecast."""
    frame = series(200, 7)
    flat = frame.assign(**dict.fromkeys(fc.FEATURES, 1.0))
    out = bo.boosted_walk(flat, 0).reset_index(drop=True)
    ups = (frame["target"] > 0).to_numpy()
    assert out["up"].to_numpy() == pytest.approx([ups[:i].mean() for i in out["i"]])
    assert len(bo.boosted_walk(frame.assign(target=0.01), 0)) == 0 and len(bo.boosted_walk(frame[:60], 0)) == 0
    assert list(bo.boosted_walk(frame[:60], 0).columns) == ["symbol", "i", "date", "up", "actual"]


def test_a_plain_signal_is_learned(monkeypatch):
    draw = np.random.default_rng(2)
    frame = series(330, 9)
    frame["target"] = np.where((frame["r1"] > 0) ^ (frame["r10"] > 0.2), 0.01, -0.01) * draw.uniform(0.5, 1, len(frame))
    monkeypatch.setattr(bo, "TREES", 50)
    got = bo.boosted_walk(frame, 2)
    assert ((got["up"] >= 0.5) == (got["actual"] > 0)).mean() > 0.8


def test_queries(spark):
    x = forecasting.mdl_07_comparison(spark, SMALL).toPandas()
    assert len(x) and x["symbol"].is_unique and x["samples"].between(1, fc.LAST).all() and x["boosted_pct"].between(0, 100).all()
