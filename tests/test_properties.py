"""Known answers and properties: no lookahead, always-in equals buy and hold, seals, quotas, streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.functions import accounts, forecast
from tidemark.functions.recursion import indicators
from tidemark.operators import log, performance
from tidemark.plans import registry
from tidemark.plans.store import predictions
from tidemark.sources.market import indexed


def test_flagship_rows(spark):
    got = registry.flagship(spark, SMALL).toPandas()
    assert len(got) == 25 and got["sharpe"].nunique() > 5


def test_always_in_is_buy_and_hold(spark):
    arms = registry.queries()["dec_07_sizing_arms"](spark, SMALL).filter("arm = 'always_in'").toPandas().set_index("symbol")["total_pct"]
    bars = indexed(spark, SMALL).toPandas().sort_values(["symbol", "date"]).groupby("symbol")["close"]
    hold = (bars.last() / bars.first() - 1) * 100
    assert np.allclose(arms.sort_index(), hold.sort_index(), atol=1e-5)


def test_no_lookahead(spark):
    """Changing every bar after a day leaves exposures up to it as they were."""
    x = indexed(spark, SMALL).filter("symbol = 'Brand#11'").withColumn("want", F.when(F.col("ret") > 0, 1.0).otherwise(0.0))
    cut = 130
    changed = x.withColumn("want", F.when(F.col("i") > cut, 1 - F.col("want")).otherwise(F.col("want")))
    a, b = (performance.backtest(t, every=1, delay=1).filter(F.col("i") <= cut + 1).orderBy("i").select("exposure").toPandas()["exposure"].tolist() for t in (x, changed))
    assert a == b


def test_append_is_idempotent_and_seals_detect(spark):
    p = predictions(spark, SMALL)
    assert log.new_rows(p, p, ["symbol", "as_of", "arm", "horizon"]).count() == 0
    assert log.integrity(p).first()["broken"] == 0
    assert log.integrity(p.withColumn("direction", F.lit("x"))).first()["broken"] == p.count()


def test_recursions_on_short_and_constant_series():
    day = pd.date_range("2024-01-01", periods=60)
    flat = pd.DataFrame({"symbol": "S", "date": day, "i": range(60), "close": 5.0})
    out = indicators(flat)
    assert out["ema12"].iloc[-1] == 5 and out["rsi"].iloc[-1] == 100 and out["hist"].iloc[-1] == 0
    assert len(indicators(flat.head(1))) == 1


def test_quota_counts_only_accepted():
    frame = pd.DataFrame({"user_id": 1, "event_id": range(5), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta([0, 1, 2, 3, 25], unit="h")})
    both = pd.concat([frame, frame.assign(user_id=2)])
    for cuts in ([10], [2, 8], [1] * 10):
        batches = np.split(np.arange(10), np.cumsum(cuts)[:-1])
        got = pd.concat(accounts.folded(dict, accounts.within_quota)(iter([both.iloc[b] for b in batches])))
        assert got["kept"].tolist() == [True, True, True, False, True] * 2


def test_paper_account_rejects_what_it_cannot_cover():
    frame = pd.DataFrame({"user_id": 1, "o_orderdate": pd.to_datetime(["2024-01-01"] * 3), "o_orderkey": [1, 2, 3], "l_linenumber": 1, "symbol": "S", "sell": [False, True, True], "shares": [10.0, 4.0, 7.0], "price": [100.0, 110.0, 120.0]})
    two = [frame.iloc[:2], frame.iloc[2:], frame.assign(user_id=2)]
    got = pd.concat(accounts.accounts(iter(two))).reset_index(drop=True)
    assert got.iloc[0].drop("user_id").equals(got.iloc[1].drop("user_id"))
    got = got.iloc[0]
    assert (got.trades, got.rejected, got.realised, got.cash) == (2, 1, 40.0, 100_000 - 1000 + 440)


def test_bootstrap_keeps_blocks():
    at = forecast.stationary_indices(1000, 10.0, np.random.default_rng(1))
    assert at.min() >= 0 and at.max() < 1000 and 0.85 < np.mean(np.diff(at) == 1) < 0.95


def test_stream_matches_batch(spark):
    stream = registry.queries()["stm_ohlc_stream"](spark, SMALL).toPandas()
    batch = registry.queries()["ext_tumbling_bars"](spark, SMALL).toPandas()
    both = stream.merge(batch, on=["symbol", "start"], suffixes=("", "_b"))
    assert len(stream) and len(both) == len(stream)
    assert (both[["open", "high", "low", "close", "ticks"]].to_numpy() == both[[f"{c}_b" for c in ("open", "high", "low", "close", "ticks")]].to_numpy()).all()
