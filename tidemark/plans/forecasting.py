"""Forecasts: features, ridge and direction models walked forward, forecast records, volatility models.

Features are windows; the models are fitted per symbol over bars that the calendar bounds,
or, pooled over symbols, from sums that Spark adds up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import boosting
from tidemark.functions import forecast as fc
from tidemark.functions import garch
from tidemark.functions.numeric import clip, rounded
from tidemark.operators import technical as ta
from tidemark.plans.registry import query
from tidemark.plans.technical import WIN, lag, over, r6
from tidemark.sources import market as m
from tidemark.sources.market import INDEXED_SQL, MARKET_SQL, by_date, last

HORIZON = 5
TINY = 1e-9


def macd_feature() -> F.Column:
    """Histogram of MACD (12, 26, 9) over the last 100 closes, each average flat at its seed, over price; in [-1, 1]."""
    closes = F.collect_list("close").over(last(100))
    mean = lambda n: F.aggregate(F.slice(closes, 1, n), F.lit(0.0), lambda a, x: a + x) / n
    start = F.struct(F.lit(0).alias("k"), mean(12).alias("fast"), mean(26).alias("slow"), (mean(12) - mean(26)).alias("signal"))

    def step(s, x):
        fast = F.when(s["k"] < 12, s["fast"]).otherwise(2 / 13 * x + 11 / 13 * s["fast"])
        slow = F.when(s["k"] < 26, s["slow"]).otherwise(2 / 27 * x + 25 / 27 * s["slow"])
        return F.struct((s["k"] + 1).alias("k"), fast.alias("fast"), slow.alias("slow"), F.when(s["k"] < 9, s["signal"]).otherwise(0.2 * (fast - slow) + 0.8 * s["signal"]).alias("signal"))

    histogram = F.aggregate(closes, start, step, lambda s: s["fast"] - s["slow"] - s["signal"])
    return F.when(F.col("i") >= 25, clip(histogram / F.greatest("close", F.lit(TINY)), -0.1, 0.1) * 10).otherwise(0.0)


def features(spark, sf_dir):
    """symbol, i, n, date, close, the 15 features known at each close, and target, the return over HORIZON bars."""
    x = m.indexed(spark, sf_dir).join(F.broadcast(m.market(spark, sf_dir).select("date", "mclose")), "date", "left")
    x = x.withColumn("mclose", F.last("mclose", ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0)))
    change = lambda n, c="close": F.col(c) / F.greatest(F.lag(c, n).over(by_date()), F.lit(TINY)) - 1
    x = x.withColumn("step", change(1))
    up, down = (F.avg(F.greatest(v, F.lit(0.0))).over(last(14)) for v in (F.col("step"), -F.col("step")))
    top, place = ta.range_features()
    columns = {"r1": F.col("step"), "r5": change(5), "r10": change(10), "r20": change(20), "sd5": F.stddev_pop("step").over(last(5)), "sd10": F.stddev_pop("step").over(last(10))}
    columns |= {f"ma{n}": F.col("close") / F.avg("close").over(last(n)) - 1 for n in (10, 20)}
    columns |= {"top20": top, "place20": place, "rsi": (50 - 100 / (1 + up / F.greatest(down, F.lit(TINY)))) / 50, "volume": ta.volume_log_ratio(), "macd": macd_feature(), "band": ta.percent_b()}
    columns |= {"relative": clip(change(5) - change(5, "mclose"), -0.5, 0.5), "target": F.lead("close", HORIZON).over(by_date()) / F.greatest("close", F.lit(TINY)) - 1}
    return x.select("symbol", "i", "n", "date", "close", *[c.alias(k) for k, c in columns.items()]).filter("i >= 30")


_SQL = {"r1": "step", "r5": f"close/{lag(5)}-1", "r10": f"close/{lag(10)}-1", "r20": f"close/{lag(20)}-1", "sd5": f"stddev_pop(step) {over(5)}", "sd10": f"stddev_pop(step) {over(10)}", "ma10": f"close/avg(close) {over(10)}-1", "ma20": f"close/avg(close) {over(20)}-1", "top20": f"close/max(close) {over(20)}-1"}
_SQL |= {"place20": f"case when max(close) {over(20)}>min(close) {over(20)} then (close-min(close) {over(20)})/(max(close) {over(20)}-min(close) {over(20)})-0.5 else 0.0 end", "rsi": f"(50-100/(1+avg(greatest(step,0)) {over(14)}/greatest(avg(greatest(-step,0)) {over(14)},1e-9)))/50"}
_SQL |= {"volume": f"greatest(least(ln(volume/avg(volume) {over(20)}),1.5),-1.5)", "band": f"case when stddev_pop(close) {over(20)}<1e-9 then 0.0 else greatest(least((close-avg(close) {over(20)})/(2*stddev_pop(close) {over(20)}),2),-2) end", "relative": f"greatest(least((close/{lag(5)}-1)-(mclose/lag(mclose,5) over w-1),0.5),-0.5)", "target": "lead(close,5) over w/close-1"}
_FEATURES = f"{INDEXED_SQL}, {MARKET_SQL}, st as (select ix.*, mclose, (close/{lag(1)}-1) as step from ix left join market using (date){WIN}), ft as (select symbol, i, n, date, {', '.join(f'{v} as {k}' for k, v in _SQL.items())} from st{WIN}), fx as (select * from ft where i>=30)"


@query("win_17_training_set", f"with {_FEATURES} select symbol, date, {', '.join(f'{r6(k)} as {k}' for k in _SQL)} from fx")
def win_17_training_set(spark, sf_dir):
    """All features but the MACD histogram, which has a query of its own."""
    return features(spark, sf_dir).select("symbol", "date", *[rounded(F.col(c)).alias(c) for c in _SQL])


@query("win_10_macd_feature")
def win_10_macd_feature(spark, sf_dir):
    return m.indexed(spark, sf_dir).withColumn("feature", macd_feature()).select("symbol", "date", rounded(F.col("feature")).alias("feature"))


@query("win_15_volume_ratio", f"with {INDEXED_SQL} select symbol, date, {r6(f'volume/avg(volume) {over(20)}')} as ratio, {r6(f'avg(volume) {over(20)}/avg(volume) {over(63)}-1')} as surge from ix{WIN}")
def win_15_volume_ratio(spark, sf_dir):
    """Volume over its mean of 20 bars with a volume, and that mean over the one of 63."""
    mean = lambda n: F.avg("volume").over(last(n))
    return m.indexed(spark, sf_dir).select("symbol", "date", rounded(F.col("volume") / mean(20)).alias("ratio"), rounded(mean(20) / mean(63) - 1).alias("surge"))


_SCALED = [f for f in fc.FEATURES if f in _SQL]


@query("mdl_01_standardise", f"with {_FEATURES}, z as (select symbol, date, i, n, " + ", ".join(f"greatest(least(({c}-avg({c}) over p)/case when stddev_pop({c}) over p<1e-9 then 1.0 else stddev_pop({c}) over p end,4.0),-4.0) as {c}" for c in _SCALED) + f" from fx window p as (partition by symbol order by date rows between 220 preceding and 1 preceding)) select symbol, date, {', '.join(f'{r6(c)} as {c}' for c in _SCALED)} from z where i>=60")
def mdl_01_standardise(spark, sf_dir):
    """z-scores by the 220 rows before, winsorised at 4; a constant feature keeps its distance."""
    before = by_date().rowsBetween(-220, -1)
    z = lambda c: clip((F.col(c) - F.avg(c).over(before)) / F.when(F.stddev_pop(c).over(before) < TINY, 1.0).otherwise(F.stddev_pop(c).over(before)), -fc.WINSOR, fc.WINSOR)
    return features(spark, sf_dir).select("symbol", "date", "i", *[rounded(z(c)).alias(c) for c in _SCALED]).filter("i >= 60").drop("i")


def _weights(kind: str):
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        window, _, alpha = fc.ASSETS["equity"][:3]
        known = frame[frame["target"].notna()].sort_values("i").tail(window)
        rows = fc.Windows(known[list(fc.FEATURES)].to_numpy(float), known["target"].to_numpy(float), np.array([0]), np.array([len(known)]))
        weights = (rows.ridge(alpha) if kind == "ridge" else rows.direction())[0]
        return pd.DataFrame({"symbol": frame["symbol"].iloc[0], "feature": ["bias", *fc.FEATURES], "weight": weights})

    return fit


@query("mdl_02_ridge")
def mdl_02_ridge(spark, sf_dir):
    """Ridge weights of each symbol from its newest training window."""
    return features(spark, sf_dir).groupBy("symbol").applyInPandas(_weights("ridge"), "symbol string, feature string, weight double").withColumn("weight", rounded(F.col("weight"), 5))


@query("mdl_03_direction")
def mdl_03_direction(spark, sf_dir):
    """Weights of the probability of a rise from the same window."""
    return features(spark, sf_dir).groupBy("symbol").applyInPandas(_weights("direction"), "symbol string, feature string, weight double").withColumn("weight", rounded(F.col("weight"), 5))


def walked(spark, sf_dir):
    return features(spark, sf_dir).groupBy("symbol").applyInPandas(lambda g: fc.walk_forward(g), fc.FORECAST)


@query("mdl_04_walk_forward")
def mdl_04_walk_forward(spark, sf_dir):
    """Ridge, probability of a rise, tie-broken direction and volatility mark of the last 120 rows of each symbol."""
    x = walked(spark, sf_dir)
    return x.select("symbol", "date", *[rounded(F.col(c), 5).alias(c) for c in ("ridge", "up", "actual")], "sign", "high_vol")


def accuracy(x, *keys):
    """Sample size, errors in percent, and directional accuracies of walked forecasts."""
    right = F.when(F.signum("ridge") == F.signum("actual"), 100.0).otherwise(0.0)
    ensemble = F.when(F.col("sign") == F.when(F.col("actual") >= 0, 1).otherwise(-1), 100.0).otherwise(0.0)
    error, calm = (F.col("ridge") - F.col("actual")) * 100, ~F.col("high_vol")
    return x.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.avg(F.abs(error)).alias("mae_pct"), F.sqrt(F.avg(error * error)).alias("rmse_pct"), F.avg(right).alias("accuracy_pct"), F.avg(ensemble).alias("ensemble_pct"),
        F.count_if(calm).alias("calm_samples"), F.coalesce(F.avg(F.when(calm, right)), F.avg(right)).alias("calm_accuracy_pct"))


@query("add_05_accuracy_report")
def add_05_accuracy_report(spark, sf_dir):
    x = accuracy(walked(spark, sf_dir), "symbol")
    return x.select("symbol", "samples", "calm_samples", *[rounded(F.col(c), 4).alias(c) for c in ("mae_pct", "rmse_pct", "accuracy_pct", "ensemble_pct", "calm_accuracy_pct")])


def pooled(x, window: int, alpha: float):
    """Forecasts of the last LAST rows, counted from each symbol's end, by one ridge over the windows of all symbols.

    Each training row counts for the cut points within ``window`` after it.  Moments, then
    sums of products of the standardised rows, are added up by Spark; what is solved per
    cut point is one system of 16 equations.
    """
    names = list(fc.FEATURES)
    rows = x.filter("target is not null").withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))) - 1)
    values = F.array(*names)
    cuts = F.sequence(F.greatest(F.col("back") - window, F.lit(0)), F.least(F.col("back") - 1, F.lit(fc.LAST - 1)))
    used = rows.filter(F.col("back").between(1, fc.LAST - 1 + window)).select("symbol", "back", values.alias("x"), "target", F.explode(cuts).alias("cut"))
    each = used.select("cut", F.posexplode("x").alias("k", "v")).groupBy("cut", "k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    moments = each.groupBy("cut").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "mean", F.when(F.col("sd") < fc.LEAST_SD, 1.0).otherwise(F.col("sd")).alias("sd")))), lambda s: F.struct(s["mean"].alias("mean"), s["sd"].alias("sd"))).alias("moments"))
    z = F.concat(F.array(F.lit(1.0)), F.zip_with("x", "moments", lambda v, s: F.greatest(F.least((v - s["mean"]) / s["sd"], F.lit(fc.WINSOR)), F.lit(-fc.WINSOR))))
    scaled = used.join(F.broadcast(moments), "cut").select("cut", z.alias("z"), "target")

    def products(batches):
        """The sums of products of each batch's rows, by cut point."""
        for frame in batches:
            for cut, part in frame.groupby("cut"):
                rows = np.c_[np.vstack(part["z"]), part["target"]]
                yield pd.DataFrame({"cut": [cut], "sums": [(rows[:, :-1].T @ rows).ravel().tolist()]})

    sums = scaled.mapInPandas(products, "cut int, sums array<double>").select("cut", F.posexplode("sums").alias("k", "v")).groupBy("cut", "k").agg(F.sum("v").alias("v"))
    gram = sums.groupBy("cut").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("sums"))

    def solve(batches):
        for frame in batches:
            size = len(names) + 1
            extra = np.diag(np.r_[0.0, np.full(size - 1, alpha)])
            weights = [np.linalg.solve(g[:, :size] + extra, g[:, size]).tolist() for g in (np.reshape(s, (size, size + 1)) for s in frame["sums"])]
            yield pd.DataFrame({"cut": frame["cut"], "weights": weights})

    fitted = gram.mapInPandas(solve, "cut int, weights array<double>").join(F.broadcast(moments), "cut")
    points = rows.filter(F.col("back") < fc.LAST).select("symbol", "date", F.col("back").alias("cut"), values.alias("x"), "target")
    predicted = F.aggregate(F.zip_with(z, "weights", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return points.join(F.broadcast(fitted), "cut").select("symbol", "date", predicted.alias("ridge"), F.col("target").alias("actual"))


@query("mdl_05_pooled")
def mdl_05_pooled(spark, sf_dir):
    """Accuracy per symbol of one fit over all symbols at each cut point."""
    x = pooled(features(spark, sf_dir), *(fc.ASSETS["equity"][k] for k in (0, 2)))
    right = F.when(F.signum("ridge") == F.signum("actual"), 100.0).otherwise(0.0)
    return x.groupBy("symbol").agg(F.count("*").alias("samples"), rounded(F.avg(right), 4).alias("accuracy_pct"), rounded(F.avg(F.abs(F.col("ridge") - F.col("actual"))) * 100, 4).alias("mae_pct"))


def live_forecasts(spark, sf_dir):
    """symbol, weights and the model's return in percent of the newest bar, with the bar's own columns."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        value, weights = fc.live(frame)
        return pd.DataFrame({"symbol": [frame["symbol"].iloc[0]], "model_pct": [value * 100], "weights": [weights.tolist()]})

    return features(spark, sf_dir).groupBy("symbol").applyInPandas(fit, "symbol string, model_pct double, weights array<double>")


def forecast_bars(spark, sf_dir):
    """Bars with what a forecast record needs of their past: close, i, n, support, resistance, vol."""
    level = lambda f: f("close").over(last(15))
    vol = F.stddev_pop("ret").over(last(39)) * 100 * F.sqrt(F.lit(float(HORIZON)))
    return m.indexed(spark, sf_dir).select("symbol", "date", "close", "i", "n", level(F.min).alias("support"), level(F.max).alias("resistance"), vol.alias("vol"))


def forecast_record(x):
    """The record of bars with close, support, resistance, vol, model_pct, mae_pct and accuracy_pct."""
    low, mid, high, scale = fc.ASSETS["equity"][3:]
    cap = low if HORIZON <= 2 else mid if HORIZON <= 7 else high
    record = x.withColumn("return_pct", clip(F.col("model_pct"), -cap, cap)).withColumn("band", F.greatest("mae_pct", F.col("vol") * scale))
    fit = F.greatest(F.lit(0.0), 1 - F.col("mae_pct") / F.greatest(F.col("band") * 1.5, F.lit(0.5)))
    signal = F.least(F.abs("return_pct") / F.greatest("band", F.lit(0.25)), F.lit(1.0))
    confidence = clip((0.22 + F.col("accuracy_pct") / 100 * 0.4 + fit * 0.23 + signal * 0.15) * 0.72, 0.28, 0.9)
    edge = F.greatest(F.lit(0.35), F.col("band") * 0.45)
    trend = F.when(F.col("return_pct") > edge, "bullish").when(F.col("return_pct") < -edge, "bearish").otherwise("sideways")
    spread = F.greatest(F.col("band") * 0.8, F.lit(0.25))
    price = lambda pct: rounded(F.col("close") * (1 + pct / 100), 2)
    return record.select(
        "symbol", "date", rounded(F.col("close"), 2).alias("price"), price(F.col("return_pct")).alias("predicted"), rounded(F.col("return_pct"), 2).alias("return_pct"), rounded(F.col("band"), 2).alias("band_pct"),
        rounded(confidence, 2).alias("confidence"), trend.alias("trend"), rounded(F.col("support"), 2).alias("support"), rounded(F.col("resistance"), 2).alias("resistance"), price(F.col("return_pct") + spread).alias("bull"), price(F.col("return_pct") - spread).alias("bear"))


@query("mdl_06_forecast")
def mdl_06_forecast(spark, sf_dir):
    """The forecast record of each symbol: capped return, price, uncertainty, confidence, trend, levels and scenarios."""
    newest = forecast_bars(spark, sf_dir).filter("i = n - 1 and n >= 90")
    return forecast_record(newest.join(accuracy(walked(spark, sf_dir), "symbol"), "symbol").join(live_forecasts(spark, sf_dir), "symbol"))


def rebalanced(spark, sf_dir, due: str):
    """Forecast records at the bars of a symbol for which ``due`` (of i and n) holds.

    Errors and accuracy at a bar are those of the walked forecasts whose targets are known
    there, LAST at most; so later bars change nothing.
    """
    walks = features(spark, sf_dir).select("symbol", "i", "target", *fc.FEATURES).groupBy("symbol").applyInPandas(lambda g: fc.ridge_walk(g, HORIZON), "symbol string, i long, walk double, model double, actual double")
    walks = walks.select("symbol", "i", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("walk", "model", "actual")])
    seen = Window.partitionBy("symbol").orderBy("i").rowsBetween(-fc.LAST - HORIZON + 1, -HORIZON)
    right = F.when(F.signum("walk") == F.signum("actual"), 100.0).when(F.col("walk").isNotNull(), 0.0)
    x = walks.select("symbol", "i", (F.col("model") * 100).alias("model_pct"), F.avg(F.abs(F.col("walk") - F.col("actual")) * 100).over(seen).alias("mae_pct"), F.avg(right).over(seen).alias("accuracy_pct"))
    return forecast_record(forecast_bars(spark, sf_dir).filter(due).join(x.filter("model_pct is not null and mae_pct is not null"), ["symbol", "i"]))


@query("mdl_06_rebalanced")
def mdl_06_rebalanced(spark, sf_dir):
    """The forecast record of each symbol at each bar of the rebalance calendar, from what was known there."""
    return rebalanced(spark, sf_dir, "i >= least(260, greatest(120, n div 3)) and (i - least(260, greatest(120, n div 3))) % 5 = 0")


@query("mdl_08_grid")
def mdl_08_grid(spark, sf_dir):
    """Mean accuracy on the first 60 % of rows by ridge penalty, and of the ensemble by direction penalty; the best of each."""
    x = features(spark, sf_dir).filter("target is not null").withColumn("rows", F.count("*").over(Window.partitionBy("symbol"))).withColumn("place", F.row_number().over(by_date()))
    tune = x.filter("place <= floor(rows * 0.6)")
    cells = F.array(*[F.struct(F.lit(float(a)).alias("ridge_penalty"), F.lit(float(b)).alias("direction_penalty")) for a, b in [(v, 1.0) for v in (0.5, 1.8, 5.0, 15.0)] + [(1.8, v) for v in (0.3, 3.0)]])
    keys = ["symbol", "ridge_penalty", "direction_penalty"]

    def run(key, frame):
        out = fc.walk_forward(frame, ridge_penalty=key[1], direction_penalty=key[2])
        return out.assign(ridge_penalty=key[1], direction_penalty=key[2])

    each = tune.withColumn("cell", F.explode(cells)).select("*", "cell.*").drop("cell")
    walked_cells = each.groupBy(*keys).applyInPandas(run, fc.FORECAST + ", ridge_penalty double, direction_penalty double")
    score = accuracy(walked_cells, *keys).groupBy("ridge_penalty", "direction_penalty").agg(F.avg("accuracy_pct").alias("accuracy_pct"), F.avg("ensemble_pct").alias("ensemble_pct"))
    everything = Window.partitionBy(F.lit(0))  # six cells
    return score.select("ridge_penalty", "direction_penalty", rounded(F.col("accuracy_pct"), 4).alias("accuracy_pct"), rounded(F.col("ensemble_pct"), 4).alias("ensemble_pct"), (F.col("ensemble_pct") == F.max("ensemble_pct").over(everything)).alias("best"))


@query("mdl_10_importance")
def mdl_10_importance(spark, sf_dir):
    """Mean size of the standardised ridge weights over symbols, largest first."""
    x = mdl_02_ridge(spark, sf_dir).filter("feature <> 'bias'").groupBy("feature").agg(F.avg(F.abs("weight")).alias("size"), F.avg("weight").alias("mean"))
    return x.select("feature", rounded(F.col("size")).alias("size"), rounded(F.col("mean")).alias("mean"), F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "feature")).alias("place"))


@query("agg_33_pooled_matrix", f"with {_FEATURES} select count(*) as rows, count(distinct symbol) as symbols, {r6('avg(r5)')} as r5, {r6('avg(sd10)')} as sd10, {r6('avg(target)')} as target from fx where target is not null")
def agg_33_pooled_matrix(spark, sf_dir):
    """The rows of all symbols are one design matrix; its size and some column means."""
    return features(spark, sf_dir).filter("target is not null").agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"), *[rounded(F.avg(c)).alias(c) for c in ("r5", "sd10", "target")])


@query("win_32_har")
def win_32_har(spark, sf_dir):
    """HAR forecasts of the variance of the next 21 bars, walked forward, beside those of the last 21."""
    x = m.indexed(spark, sf_dir).select("symbol", "i", "ret").groupBy("symbol").applyInPandas(lambda g: fc.har_forecasts(g), "symbol string, i long, har double, rw double, realised double")
    return x.select("symbol", "i", *[rounded(F.col(c), 8).alias(c) for c in ("har", "rw", "realised")])


@query("win_33_garch_fallback", f"with {INDEXED_SQL}, g as (select symbol, i, n, var_pop(ret) over (partition by symbol order by date rows between 21 preceding and 1 preceding) as v from ix) select symbol, i, floor(v*1e10+0.5)/1e10 as variance from g where i>=501 and (i-501)%21=0 and i<n-21")
def win_33_garch_fallback(spark, sf_dir):
    """Where no GARCH fit is to be had the forecast is the variance of the last 21 returns, at each step of the grid."""
    x = m.indexed(spark, sf_dir).withColumn("v", F.var_pop("ret").over(by_date().rowsBetween(-21, -1)))
    return x.filter("i >= 501 and (i - 501) % 21 = 0 and i < n - 21").select("symbol", "i", rounded(F.col("v"), 10).alias("variance"))


_VARIANCES = "symbol string, i long, garch double, rw double, mean double, ewma double, realised double, alpha double, beta double, converged boolean"


def variances(spark, sf_dir):
    """Forecasts of each symbol's next 21 bars at the points of the grid; the calendar bounds a symbol's rows."""
    # Few rows and much work: a number of partitions of their own keeps symbols from being put into one task.
    x = m.indexed(spark, sf_dir).select("symbol", "i", "ret").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "symbol")
    return x.groupBy("symbol").applyInPandas(lambda g: garch.garch_forecasts(g), _VARIANCES)


@query("win_33_garch")
def win_33_garch(spark, sf_dir):
    """GARCH(1,1) by maximum likelihood at each point of the grid; the last 21 returns' variance where it does not converge."""
    return variances(spark, sf_dir).select("symbol", "i", *[rounded(F.col(c), 8).alias(c) for c in ("garch", "rw", "realised")], *[rounded(F.col(c), 3).alias(c) for c in ("alpha", "beta")], "converged")


@query("agg_29_volatility_models")
def agg_29_volatility_models(spark, sf_dir):
    """QLIKE and squared error of five variance forecasts on the same points, pooled over symbols; best first by QLIKE."""
    har = m.indexed(spark, sf_dir).select("symbol", "i", "ret").groupBy("symbol").applyInPandas(lambda g: fc.har_forecasts(g), "symbol string, i long, har double, rw double, realised double")
    both = variances(spark, sf_dir).join(har.select("symbol", "i", "har"), ["symbol", "i"]).filter("realised > 0")
    models = F.explode(F.array(*(F.struct(F.lit(c).alias("model"), F.greatest(F.col(c), F.lit(1e-12)).alias("f")) for c in ("rw", "mean", "ewma", "har", "garch"))))
    x = both.select("symbol", "i", "realised", models.alias("x")).select("symbol", "realised", "x.model", "x.f")
    error = F.col("f") - F.col("realised")
    return x.groupBy("model").agg(F.count("*").alias("n"), rounded(F.avg(F.log("f") + F.col("realised") / F.col("f"))).alias("qlike"), rounded(F.avg(error * error) * 1e8).alias("mse_e8"), rounded(F.corr("f", "realised"), 4).alias("r")).orderBy("qlike")


@query("mdl_07_boosting")
def mdl_07_boosting(spark, sf_dir):
    """Boosted trees over all symbols, fitted on the rows before the last LAST of each; their accuracy on those."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    x = features(spark, sf_dir).filter("target is not null").withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    x = x.withColumn("rise", F.when(F.col("target") > 0, 1.0).otherwise(0.0)).repartition("symbol").sortWithinPartitions("symbol", "date")
    rows = VectorAssembler(inputCols=list(fc.FEATURES), outputCol="features").transform(x)
    model = GBTClassifier(labelCol="rise", maxIter=8, maxDepth=3, stepSize=0.1, seed=7).fit(rows.filter(F.col("back") > fc.LAST))
    scored = model.transform(rows.filter(F.col("back") <= fc.LAST))
    right = F.when(F.col("prediction") == F.col("rise"), 100.0).otherwise(0.0)
    return scored.groupBy("symbol").agg(F.count("*").alias("samples"), rounded(F.avg(right), 4).alias("accuracy_pct"))


def boosted(spark, sf_dir):
    """symbol, i, date, up, actual of the last LAST rows of each symbol by trees refitted at every one of them.

    A group is one symbol's part of the cut points with the rows that these can reach, so
    its size is a constant and a symbol's fits spread over tasks.
    """
    reach = fc.LAST + fc.ASSETS["equity"][0]
    x = features(spark, sf_dir).filter("target is not null").withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    each = x.filter(F.col("back") <= reach).withColumn("part", F.explode(F.array(*map(F.lit, range(boosting.parts())))))
    # Few rows and much work: AQE would put all groups into one task.
    each = each.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "symbol", "part")
    return each.groupBy("symbol", "part").applyInPandas(lambda key, g: boosting.boosted_walk(g, int(key[1])), boosting.BOOSTED)


@query("mdl_07_walk_forward")
def mdl_07_walk_forward(spark, sf_dir):
    """Boosted trees walked forward: the probability of a rise at each of the last 120 rows of a symbol, from the window before it."""
    return boosted(spark, sf_dir).select("symbol", "date", rounded(F.col("up"), 5).alias("up"), rounded(F.col("actual"), 5).alias("actual"))


@query("mdl_07_comparison")
def mdl_07_comparison(spark, sf_dir):
    """Directional accuracy of the trees by symbol beside that of the direction model on the same rows and windows."""
    rise = F.when(F.col("actual") > 0, 1).otherwise(-1)
    hit = lambda c: F.avg(F.when(F.when(F.col(c) >= 0.5, 1).otherwise(-1) == rise, 100.0).otherwise(0.0))
    x = boosted(spark, sf_dir).join(walked(spark, sf_dir).select("symbol", "i", F.col("up").alias("plain")), ["symbol", "i"])
    return x.groupBy("symbol").agg(F.count("*").alias("samples"), rounded(hit("up"), 4).alias("boosted_pct"), rounded(hit("plain"), 4).alias("direction_pct"))
