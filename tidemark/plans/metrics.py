"""Queries on returns: performance metrics, risk, backtests, baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.distributions import binomial_two_sided, binomial_two_sided_sql, correlation_p, t_two_sided, t_two_sided_sql
from tidemark.functions.numeric import clip, rounded, wilson
from tidemark.operators import performance as perf
from tidemark.operators import significance as sig
from tidemark.operators import technical as ta
from tidemark.plans.registry import query
from tidemark.plans.technical import WIN, lag, over, r6
from tidemark.sources import market as m
from tidemark.sources import shared
from tidemark.sources.market import by_date, INDEXED_SQL, MARKET_SQL, last

_RET = INDEXED_SQL + ", rt as (select symbol, date, i, n, close, ret from ix where ret is not null)"
_STATS = f"""case when stddev_pop(ret)<1e-12 then 0.0 else {r6('sqrt(252.0)*(avg(ret)-0.04/252)/stddev_pop(ret)')} end as sharpe,
 {r6('sqrt(252.0)*(avg(ret)-0.04/252)/stddev_pop(ret-0.04/252) filter (ret-0.04/252<0)')} as sortino"""
_PATH = ", eq as (select *, exp(sum(ln(1+ret)) over (partition by symbol order by date)) as e from rt), dd as (select *, (e-greatest(1.0, max(e) over (partition by symbol order by date)))/greatest(1.0, max(e) over (partition by symbol order by date))*100 as d from eq)"


@query(
    "agg_01_performance",
    f"with {_RET}{_PATH} select symbol, count(*) as bars, {_STATS}, {r6('min(d)')} as max_drawdown_pct, {r6('(power(exp(sum(ln(1+ret))),252.0/count(*))-1)*100')} as annual_pct from dd group by symbol",
)
def agg_01_performance(spark, sf_dir):
    """The flagship: performance and drawdown of every symbol."""
    x = m.indexed(spark, sf_dir).filter("ret is not null")
    return perf.summary(perf.with_drawdown(x), ["symbol"])


@query("agg_02_sortino", f"with {_RET} select symbol, {r6('sqrt(252.0)*(avg(ret)-0.04/252)/stddev_pop(ret-0.04/252) filter (ret-0.04/252<0)')} as sortino from rt group by symbol")
def agg_02_sortino(spark, sf_dir):
    return m.indexed(spark, sf_dir).filter("ret is not null").groupBy("symbol").agg(rounded(perf.sortino(F.col("ret"))).alias("sortino"))


@query("agg_03_max_drawdown", f"with {_RET}{_PATH} select symbol, {r6('min(d)')} as max_drawdown_pct, {r6('max(e)')} as peak from dd group by symbol")
def agg_03_max_drawdown(spark, sf_dir):
    x = perf.with_drawdown(m.indexed(spark, sf_dir).filter("ret is not null"))
    return x.groupBy("symbol").agg(rounded(F.min("dd_pct")).alias("max_drawdown_pct"), rounded(F.max("equity")).alias("peak"))


@query("agg_04_annualised", f"with {_RET} select symbol, {r6('(power(exp(sum(ln(1+ret))),252.0/count(*))-1)*100')} as annual_pct, {r6('(exp(sum(ln(1+ret)))-1)*100')} as total_pct from rt group by symbol")
def agg_04_annualised(spark, sf_dir):
    return m.indexed(spark, sf_dir).filter("ret is not null").groupBy("symbol").agg(rounded(perf.annual_pct(F.col("ret"))).alias("annual_pct"), rounded((F.exp(F.sum(F.log(1 + F.col("ret")))) - 1) * 100).alias("total_pct"))


# The momentum strategy used by the segment queries: long after a rising 20-bar average, decided at the close, earned on the next bar.
_STRAT = f"""st as (select symbol, date, i, n, case when i>=49 and avg(close) {over(20)}>avg(close) {over(50)} then 1.0 else 0.0 end as e, lead(close) over w/close-1 as nxt from ix{WIN}),
 sg as (select *, case when i<round_even(n*0.6,0) then 'tune' else 'holdout' end as segment, e*nxt as r from st where nxt is not null)"""


def _strategy(spark, sf_dir):
    x = m.indexed(spark, sf_dir)
    e = F.when((F.col("i") >= 49) & (F.avg("close").over(last(20)) > F.avg("close").over(last(50))), 1.0).otherwise(0.0)
    x = x.withColumn("e", e).withColumn("nxt", ta.forward_return(1)).withColumn("segment", F.when(F.col("i") < F.bround(F.col("n") * 0.6), "tune").otherwise("holdout"))
    return x.filter("nxt is not null").withColumn("r", F.col("e") * F.col("nxt"))


@query("agg_06_buy_and_hold", f"with {INDEXED_SQL}, {_STRAT} select symbol, segment, {r6('(exp(sum(ln(1+nxt)))-1)*100')} as hold_pct, {r6('(exp(sum(ln(1+r)))-1)*100')} as strategy_pct from sg group by 1, 2")
def agg_06_buy_and_hold(spark, sf_dir):
    return _strategy(spark, sf_dir).groupBy("symbol", "segment").agg(rounded((F.exp(F.sum(F.log(1 + F.col("nxt")))) - 1) * 100).alias("hold_pct"), rounded((F.exp(F.sum(F.log(1 + F.col("r")))) - 1) * 100).alias("strategy_pct"))


@query("agg_07_compact_stats", f"with {_RET}, eq as (select *, exp(sum(ln(1+ret)) over (partition by symbol order by date)) as e from rt), d as (select *, e/max(e) over (partition by symbol order by date)-1 as dd from eq) select symbol, {r6('stddev_pop(ret)*sqrt(252.0)*100')} as vol_pct, {r6('min(dd)*100')} as dd_pct from d group by symbol")
def agg_07_compact_stats(spark, sf_dir):
    """Without a starting equity of 1, so a loss on the first day does not show as drawdown."""
    x = perf.with_drawdown(m.indexed(spark, sf_dir).filter("ret is not null"), include_start=False)
    return x.groupBy("symbol").agg(rounded(F.stddev_pop("ret") * F.sqrt(F.lit(252.0)) * 100).alias("vol_pct"), rounded(F.min("dd_pct")).alias("dd_pct"))


@query(
    "agg_08_cross_ticker",
    f"with {INDEXED_SQL}, {_STRAT}, t as (select symbol, segment, (exp(sum(ln(1+nxt)))-1)*100 as h, (exp(sum(ln(1+r)))-1)*100 as s from sg group by 1, 2) select segment, count(*) as tickers, {r6('avg(s)')} as mean_pct, {r6('median(s)')} as median_pct, count(*) filter (s>h) as wins from t group by segment",
)
def agg_08_cross_ticker(spark, sf_dir):
    t = _strategy(spark, sf_dir).groupBy("symbol", "segment").agg(((F.exp(F.sum(F.log(1 + F.col("nxt")))) - 1) * 100).alias("h"), ((F.exp(F.sum(F.log(1 + F.col("r")))) - 1) * 100).alias("s"))
    return t.groupBy("segment").agg(F.count("*").alias("tickers"), rounded(F.avg("s")).alias("mean_pct"), rounded(F.median("s")).alias("median_pct"), F.count_if(F.col("s") > F.col("h")).alias("wins"))


@query("agg_09_historical_var", f"with {_RET} select symbol, {r6('greatest(-quantile_cont(ret,0.05),0)')} as var95, {r6('greatest(-quantile_cont(ret,0.05),0)*10000')} as var_usd, {r6('stddev_pop(ret)')} as vol from rt where i>=n-119 group by symbol having count(*)>=30")
def agg_09_historical_var(spark, sf_dir):
    """The last 120 closes, so 119 returns."""
    x = m.indexed(spark, sf_dir).filter("ret is not null and i >= n - 119")
    var = F.greatest(-F.percentile("ret", F.lit(0.05)), F.lit(0.0))
    return x.groupBy("symbol").agg(rounded(var).alias("var95"), rounded(var * 10000).alias("var_usd"), rounded(F.stddev_pop("ret")).alias("vol"), F.count("*").alias("c")).filter("c >= 30").drop("c")


@query(
    "agg_10_var_cvar",
    f"with {_RET}, o as (select symbol, list(ret order by ret) as rs, count(*) as c from rt group by symbol) select symbol, {r6('-rs[greatest(0,cast(floor(0.05*c) as int)-1)+1]*sqrt(5.0)')} as var95, {r6('-list_avg(rs[1:greatest(0,cast(floor(0.05*c) as int)-1)+1])*sqrt(5.0)')} as cvar95 from o",
)
def agg_10_var_cvar(spark, sf_dir):
    """Order statistics: a symbol's returns fit an array, which the calendar bounds."""
    x = m.indexed(spark, sf_dir).filter("ret is not null").groupBy("symbol").agg(F.array_sort(F.collect_list("ret")).alias("rs"))
    k = F.greatest(F.lit(0), F.floor(0.05 * F.size("rs")).cast("int") - 1) + 1
    tail = F.aggregate(F.slice("rs", 1, k), F.lit(0.0), lambda a, v: a + v) / k
    return x.select("symbol", rounded(-F.element_at("rs", k) * F.sqrt(F.lit(5.0))).alias("var95"), rounded(-tail * F.sqrt(F.lit(5.0))).alias("cvar95"))


_DECISION = f"""dc as (select symbol, date, i, n, close, case when {lag(20)} is not null and close>{lag(20)} then 1.0 else 0.0 end as want, least(260,greatest(120,n//3)) as st from ix{WIN}),
 sched as (select *, case when i>=st and (i-st)%5=0 then want end as decided from dc),
 eff as (select *, last_value(lag_decided ignore nulls) over (partition by symbol order by date rows between unbounded preceding and current row) as exposure from (select *, lag(decided, 1) over w as lag_decided from sched{WIN}))"""


@query(
    "win_27_backtest",
    f"with {INDEXED_SQL}, {_DECISION}, bk as (select symbol, date, i, coalesce(exposure,0.0) as exposure, lead(close) over w/close-1 as nxt from eff{WIN}) select symbol, {r6('exp(sum(ln(1+exposure*nxt)))-1')} as total, {r6('avg(exposure)')} as exposure, count(*) as days from bk where nxt is not null group by symbol",
)
def win_27_backtest(spark, sf_dir):
    """Decide on rebalance days, adopt one bar later, then book: set-wise, without a loop."""
    x = perf.backtest(m.indexed(spark, sf_dir).withColumn("want", F.when(F.col("close") > F.lag("close", 20).over(by_date()), 1.0).otherwise(0.0)), every=5, delay=1)
    x = x.withColumn("nxt", ta.forward_return(1)).filter("nxt is not null")
    return x.groupBy("symbol").agg(rounded(F.exp(F.sum(F.log(1 + F.col("exposure") * F.col("nxt")))) - 1).alias("total"), rounded(F.avg("exposure")).alias("exposure"), F.count("*").alias("days"))


@query(
    "win_28_buy_signal_return",
    f"with {INDEXED_SQL}, {_DECISION}, bk as (select *, lead(close,6) over w/lead(close,1) over w-1 as fwd from eff{WIN}) select symbol, count(*) as signals, {r6('avg(fwd)')} as mean_fwd, {r6('avg(case when fwd>0 then 1.0 else 0.0 end)')} as hit from bk where decided=1 and coalesce(exposure,0.0)=0 and fwd is not null group by symbol",
)
def win_28_buy_signal_return(spark, sf_dir):
    x = perf.backtest(m.indexed(spark, sf_dir).withColumn("want", F.when(F.col("close") > F.lag("close", 20).over(by_date()), 1.0).otherwise(0.0)), every=5, delay=1)
    x = x.withColumn("fwd", F.lead("close", 6).over(by_date()) / F.lead("close", 1).over(by_date()) - 1).filter("decided = 1 and exposure = 0 and fwd is not null")
    return x.groupBy("symbol").agg(F.count("*").alias("signals"), rounded(F.avg("fwd")).alias("mean_fwd"), rounded(F.avg(F.when(F.col("fwd") > 0, 1.0).otherwise(0.0))).alias("hit"))


@query(
    "win_29_segment_windows",
    f"""with {INDEXED_SQL}, sx as (select *, case when i<round_even(n*0.6,0) then 'tune' else 'holdout' end as segment from ix), rw as (select *, row_number() over v-1 as j, avg(close) over (partition by symbol, segment order by date rows between 19 preceding and current row) as f, avg(close) over (partition by symbol, segment order by date rows between 49 preceding and current row) as s, lead(close) over v/close-1 as nxt from sx window v as (partition by symbol, segment order by date))
    select symbol, segment, {r6('exp(sum(ln(1+case when j>=49 and f>s then nxt else 0 end)))-1')} as sma_total from rw where nxt is not null group by 1, 2""",
)
def win_29_segment_windows(spark, sf_dir):
    """The crossover baseline warms up anew inside each segment."""
    x = m.indexed(spark, sf_dir).withColumn("segment", F.when(F.col("i") < F.bround(F.col("n") * 0.6), "tune").otherwise("holdout"))
    v = Window.partitionBy("symbol", "segment").orderBy("date")
    x = x.withColumn("on", (F.row_number().over(v) > 49) & (F.avg("close").over(v.rowsBetween(-19, 0)) > F.avg("close").over(v.rowsBetween(-49, 0)))).withColumn("nxt", F.lead("close").over(v) / F.col("close") - 1)
    return x.filter("nxt is not null").groupBy("symbol", "segment").agg(rounded(F.exp(F.sum(F.log(1 + F.when(F.col("on"), F.col("nxt")).otherwise(0.0)))) - 1).alias("sma_total"))


_PRED = f"pd as (select symbol, date, i, {lag(0)}/{lag(20)}-1 as score, lead(close,5) over w/close-1 as fwd, stddev_pop(ret) {over(21)} as sd from ix{WIN}), pp as (select * from pd where score is not null and fwd is not null and i>=21)"


def _predictions(spark, sf_dir):
    x = m.indexed(spark, sf_dir).withColumn("score", ta.momentum(20)).withColumn("fwd", ta.forward_return(5)).withColumn("sd", F.stddev_pop("ret").over(last(21)))
    return x.filter("score is not null and fwd is not null and i >= 21")


_SIGN = "case when sign(score)=sign(fwd) then 1.0 else 0.0 end"


@query(
    "agg_24_forecast_errors",
    f"with {INDEXED_SQL}, {_PRED} select symbol, count(*) as n, {r6('avg(abs(score-fwd))')} as mae, {r6('sqrt(avg((score-fwd)*(score-fwd)))')} as rmse, {r6(f'avg({_SIGN})')} as accuracy, {r6(f'avg({_SIGN}) filter (abs(score)>0.05)')} as filtered from pp group by symbol",
)
def agg_24_forecast_errors(spark, sf_dir):
    hit = F.when(F.signum("score") == F.signum("fwd"), 1.0).otherwise(0.0)
    err = F.col("score") - F.col("fwd")
    return _predictions(spark, sf_dir).groupBy("symbol").agg(
        F.count("*").alias("n"), rounded(F.avg(F.abs(err))).alias("mae"), rounded(F.sqrt(F.avg(err * err))).alias("rmse"), rounded(F.avg(hit)).alias("accuracy"), rounded(F.avg(F.when(F.abs("score") > 0.05, hit))).alias("filtered"))


_WLO = "(({k}/{n}+3.8416/(2*{n})-1.96*sqrt({k}/{n}*(1-{k}/{n})/{n}+3.8416/(4*{n}*{n})))/(1+3.8416/{n}))"
_WHI = "(({k}/{n}+3.8416/(2*{n})+1.96*sqrt({k}/{n}*(1-{k}/{n})/{n}+3.8416/(4*{n}*{n})))/(1+3.8416/{n}))"


@query("agg_23_wilson", f"with {INDEXED_SQL}, {_PRED}, h as (select symbol, cast(count(*) as double) as n, sum({_SIGN}) as k from pp group by symbol) select symbol, {r6(_WLO.format(k='k', n='n'))} as low, {r6(_WHI.format(k='k', n='n'))} as high from h")
def agg_23_wilson(spark, sf_dir):
    h = _predictions(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.when(F.signum("score") == F.signum("fwd"), 1.0).otherwise(0.0)).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return h.select("symbol", rounded(low).alias("low"), rounded(high).alias("high"))


_RANKS = "rk as (select *, rank() over (partition by {g} order by score)+(count(*) over (partition by {g}, score)-1)/2.0 as rs, rank() over (partition by {g} order by fwd)+(count(*) over (partition by {g}, fwd)-1)/2.0 as rf from pp)"


def _ranked(x, group):
    w = Window.partitionBy(group)
    for c, name in (("score", "rs"), ("fwd", "rf")):
        x = x.withColumn(name, F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(group, c)) - 1) / 2.0)
    return x


_DEC = "q as (select *, cast(ceil(10.0*row_number() over (partition by symbol order by score, date)/count(*) over (partition by symbol))-1 as int) as decile from pp)"


@query("agg_26_deciles", f"with {INDEXED_SQL}, {_PRED}, {_DEC} select symbol, decile, count(*) as n, {r6('avg(fwd)')} as mean_fwd, {r6('min(score)')} as from_score from q group by 1, 2")
def agg_26_deciles(spark, sf_dir):
    x = _predictions(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("score", "date"))
    x = x.withColumn("decile", (F.ceil(10.0 * rank / F.count("*").over(ta.all_bars())) - 1).cast("int"))
    return x.groupBy("symbol", "decile").agg(F.count("*").alias("n"), rounded(F.avg("fwd")).alias("mean_fwd"), rounded(F.min("score")).alias("from_score"))


@query(
    "agg_26_welch_spread",
    f"with {INDEXED_SQL}, {_PRED}, {_DEC}, g as (select decile, count(*) as n, avg(fwd) as a, var_samp(fwd) as v from q where decile in (0, 9) group by decile) select {r6('t.a-b.a')} as spread, {r6('(t.a-b.a)/sqrt(t.v/t.n+b.v/b.n)')} as welch_t, t.n as n_top from g t, g b where t.decile=9 and b.decile=0",
)
def agg_26_welch_spread(spark, sf_dir):
    x = _predictions(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("score", "date"))
    x = x.withColumn("decile", (F.ceil(10.0 * rank / F.count("*").over(ta.all_bars())) - 1).cast("int"))
    top, low = F.when(F.col("decile") == 9, F.col("fwd")), F.when(F.col("decile") == 0, F.col("fwd"))
    g = x.agg(F.avg(top).alias("ta"), F.avg(low).alias("ba"), F.var_samp(top).alias("tv"), F.var_samp(low).alias("bv"), F.count(top).alias("tn"), F.count(low).alias("bn"))
    return g.select(rounded(F.col("ta") - F.col("ba")).alias("spread"), rounded((F.col("ta") - F.col("ba")) / F.sqrt(F.col("tv") / F.col("tn") + F.col("bv") / F.col("bn"))).alias("welch_t"), F.col("tn").alias("n_top"))


_CAL = "cb as (select *, 1/(1+exp(-20*score)) as p, case when fwd>0 then 1.0 else 0.0 end as y from pp)"


@query(
    "agg_27_calibration",
    f"with {INDEXED_SQL}, {_PRED}, {_CAL}, b as (select least(cast(floor(p*10) as int), 9) as bin, count(*) as n, avg(p) as mp, avg(y) as my from cb group by 1) select bin, n, {r6('mp')} as predicted, {r6('my')} as observed, {r6('abs(mp-my)*n/sum(n) over ()')} as ece_part from b",
)
def agg_27_calibration(spark, sf_dir):
    x = _predictions(spark, sf_dir).withColumn("p", 1 / (1 + F.exp(-20 * F.col("score")))).withColumn("y", F.when(F.col("fwd") > 0, 1.0).otherwise(0.0))
    b = x.groupBy(F.least(F.floor(F.col("p") * 10).cast("int"), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    everything = Window.partitionBy(F.lit(0))  # ten rows
    return b.select("bin", "n", rounded(F.col("mp")).alias("predicted"), rounded(F.col("my")).alias("observed"), rounded(F.abs(F.col("mp") - F.col("my")) * F.col("n") / F.sum("n").over(everything)).alias("ece_part"))


@query("agg_27_brier", f"with {INDEXED_SQL}, {_PRED}, {_CAL} select {r6('avg((p-y)*(p-y))')} as brier, {r6('avg(y)*(1-avg(y))')} as base_brier, count(*) as n from cb")
def agg_27_brier(spark, sf_dir):
    x = _predictions(spark, sf_dir).withColumn("p", 1 / (1 + F.exp(-20 * F.col("score")))).withColumn("y", F.when(F.col("fwd") > 0, 1.0).otherwise(0.0))
    return x.agg(rounded(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).alias("brier"), rounded(F.avg("y") * (1 - F.avg("y"))).alias("base_brier"), F.count("*").alias("n"))


@query("agg_28_gap_slope", f"with {INDEXED_SQL}, {_PRED}, {_CAL}, b as (select least(cast(floor(p*10) as int), 9) as bin, avg(p)-avg(y) as gap from cb group by 1) select {r6('regr_slope(gap, bin)')} as slope, count(*) as bins from b")
def agg_28_gap_slope(spark, sf_dir):
    x = _predictions(spark, sf_dir).withColumn("p", 1 / (1 + F.exp(-20 * F.col("score")))).withColumn("y", F.when(F.col("fwd") > 0, 1.0).otherwise(0.0))
    b = x.groupBy(F.least(F.floor(F.col("p") * 10).cast("int"), F.lit(9)).alias("bin")).agg((F.avg("p") - F.avg("y")).alias("gap"))
    return b.agg(rounded(F.regr_slope("gap", "bin")).alias("slope"), F.count("*").alias("bins"))


_VF = f"vf as (select symbol, i, var_pop(ret) {over(21)} as f, var_pop(ret) over (partition by symbol order by date rows between 1 following and 21 following) as rv, n from ix), vg as (select * from vf where i>=42 and i<n-21 and i%21=0 and f>0 and rv>0)"


def _vol_grid(spark, sf_dir):
    x = m.indexed(spark, sf_dir).withColumn("f", F.var_pop("ret").over(last(21))).withColumn("rv", F.var_pop("ret").over(by_date().rowsBetween(1, 21)))
    return x.filter("i >= 42 and i < n - 21 and i % 21 = 0 and f > 0 and rv > 0")


@query("agg_29_qlike", f"with {INDEXED_SQL}, {_VF} select symbol, {r6('avg(ln(f)+rv/f)')} as qlike, {r6('avg((f-rv)*(f-rv))*1e6')} as mse_e6, {r6('regr_slope(rv, f)')} as mz_slope, {r6('power(corr(rv, f),2)')} as mz_r2 from vg group by symbol having count(*)>5")
def agg_29_qlike(spark, sf_dir):
    x = _vol_grid(spark, sf_dir).groupBy("symbol").agg(
        rounded(F.avg(F.log("f") + F.col("rv") / F.col("f"))).alias("qlike"), rounded(F.avg((F.col("f") - F.col("rv")) * (F.col("f") - F.col("rv"))) * 1e6).alias("mse_e6"),
        rounded(F.regr_slope("rv", "f")).alias("mz_slope"), rounded(F.pow(F.corr("rv", "f"), F.lit(2.0))).alias("mz_r2"), F.count("*").alias("c"))
    return x.filter("c > 5").drop("c")


@query(
    "agg_30_coverage_curve",
    f"with {INDEXED_SQL}, {_PRED}, o as (select *, row_number() over (order by abs(score) desc, symbol, date) as rk, count(*) over () as c from pp), cv as (select unnest([100,75,50,25,10]) as coverage) select coverage, count(*) as n, {r6(f'avg({_SIGN})')} as accuracy from o join cv on rk<=greatest(1, c*coverage//100) group by coverage",
)
def agg_30_coverage_curve(spark, sf_dir):
    """Accuracy of the most confident share, from counts by confidence value: no global row numbering."""
    x = _predictions(spark, sf_dir)
    return perf.coverage_curve(x.withColumn("confidence", F.abs("score")), [100, 75, 50, 25, 10], ["symbol", "date"])


@query("agg_31_rank_ic", f"with {INDEXED_SQL}, {_PRED}, {_RANKS.format(g='date')}, d as (select date, corr(rs, rf) as ic from rk group by date having count(*)>=4 and stddev_pop(rs)>0 and stddev_pop(rf)>0) select {r6('avg(ic)')} as mean_ic, {r6('avg(ic)/stddev_pop(ic)')} as icir, {r6('avg(ic)/stddev_pop(ic)*sqrt(count(*))')} as t, {r6('avg(case when ic>1e-12 then 1.0 else 0.0 end)')} as positive, count(*) as dates from d")
def agg_31_rank_ic(spark, sf_dir):
    x = _ranked(_predictions(spark, sf_dir), "date")
    d = x.groupBy("date").agg(F.covar_pop("rs", "rf").alias("cov"), F.stddev_pop("rs").alias("a"), F.stddev_pop("rf").alias("b"), F.count("*").alias("c")).filter("c >= 4 and a > 0 and b > 0")
    d = d.withColumn("ic", F.col("cov") / F.col("a") / F.col("b"))
    ir = F.avg("ic") / F.stddev_pop("ic")
    return d.agg(rounded(F.avg("ic")).alias("mean_ic"), rounded(ir).alias("icir"), rounded(ir * F.sqrt(F.count("*"))).alias("t"), rounded(F.avg(F.when(F.col("ic") > 1e-12, 1.0).otherwise(0.0))).alias("positive"), F.count("*").alias("dates"))


_FEATS = ("score", "sd", "fwd")


@query("agg_32_correlations", f"with {INDEXED_SQL}, {_PRED} " + " union all ".join(f"select '{a}' as a, '{b}' as b, {r6(f'corr({a},{b})')} as r from pp" for i, a in enumerate(_FEATS) for b in _FEATS[i + 1 :]))
def agg_32_correlations(spark, sf_dir):
    pairs = [(a, b) for i, a in enumerate(_FEATS) for b in _FEATS[i + 1 :]]
    row = _predictions(spark, sf_dir).agg(*[rounded(F.corr(a, b)).alias(f"{a}_{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


@query("sta_03_newey_west", f"with {_RET}, dm as (select symbol, date, ret-avg(ret) over (partition by symbol) as d from rt), l as (select symbol, d, lag(d,1) over w as d1, lag(d,2) over w as d2, lag(d,3) over w as d3 from dm{WIN}) select symbol, floor((sum(d*d)/count(*)+2*(0.75*sum(d*d1)/count(*)+0.5*sum(d*d2)/count(*)+0.25*sum(d*d3)/count(*)))*1e10+0.5)/1e10 as lrv from l group by symbol")
def sta_03_newey_west(spark, sf_dir):
    """Bartlett weights over three lags."""
    x = m.indexed(spark, sf_dir).filter("ret is not null").withColumn("d", F.col("ret") - F.avg("ret").over(ta.all_bars()))
    for k in (1, 2, 3):
        x = x.withColumn(f"d{k}", F.lag("d", k).over(by_date()))
    total = F.sum(F.col("d") * F.col("d")) / F.count("*")
    for k in (1, 2, 3):
        total = total + 2 * (1 - k / 4) * F.sum(F.col("d") * F.col(f"d{k}")) / F.count("*")
    return x.groupBy("symbol").agg(rounded(total, 10).alias("lrv"))


_SPANS = (1, 5, 21)
_BY_SPAN = "hz as (select symbol, date, " + lag(0) + "/" + lag(20) + "-1 as score, unnest([1, 5, 21]) as h, unnest([" + ", ".join(f"lead(close, {h}) over w/close-1" for h in _SPANS) + "]) as fwd from ix" + WIN + "), hp as (select * from hz where score is not null and fwd is not null)"


def dm_sql(loss_a: str, loss_b: str) -> str:
    """Lagged products by a join of row numbers."""
    return f"""with {INDEXED_SQL}, {_BY_SPAN},
l as materialized (select symbol, h, row_number() over (partition by symbol, h order by date) as i, {loss_a} as a, {loss_b} as b from hp),
m as (select symbol, h, count(*) as n, avg(a) as ma, avg(b) as mb from l group by 1, 2),
c as materialized (select symbol, h, i, a-b-(ma-mb) as c from l join m using (symbol, h)),
v as (select x.symbol, x.h, sum(case when x.i=y.i then x.c*y.c else 2*(1-(x.i-y.i)/x.h)*x.c*y.c end) as total from c x join c y on x.symbol=y.symbol and x.h=y.h and y.i between x.i-x.h+1 and x.i group by 1, 2),
t as (select symbol, h, n, ma, mb, (ma-mb)/sqrt(greatest(total/n, 1e-18)/n)*sqrt(greatest((n+1-2*h+h*(h-1)/n)/n, 1e-12)) as dm from m join v using (symbol, h) where n>=3)
select symbol, h, n, {r6('ma')} as mean_a, {r6('mb')} as mean_b, {r6('dm')} as dm, {r6(t_two_sided_sql('dm', '(n-1)'))} as p_value from t"""


def _spans(spark, sf_dir):
    """symbol, date, score, h and the return of the h bars after."""
    x = m.indexed(spark, sf_dir).withColumn("score", ta.momentum(20))
    x = x.select("symbol", "date", "i", "score", *(ta.forward_return(h).alias(f"f{h}") for h in _SPANS))
    ahead = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"f{h}").alias("fwd")) for h in _SPANS)))
    return x.select("symbol", "date", "i", "score", ahead.alias("x")).select("symbol", "date", "i", "score", "x.h", "x.fwd").filter("score is not null and fwd is not null")


def _compared(x, losses):
    parts = [sig.diebold_mariano(x.filter(F.col("h") == h), ["symbol", "h"], ["date"], *losses, horizon=h).filter("n >= 3") for h in _SPANS]
    return reduce(lambda a, b: a.union(b), parts).select("symbol", "h", "n", *(rounded(F.col(c)).alias(c) for c in ("mean_a", "mean_b", "dm", "p_value")))


@query("sta_04_diebold_mariano", dm_sql("(score-fwd)*(score-fwd)", "fwd*fwd"))
def sta_04_diebold_mariano(spark, sf_dir):
    """Squared errors of the score against those of predicting 0, at three horizons."""
    err = F.col("score") - F.col("fwd")
    return _compared(shared.stored(_spans(spark, sf_dir)), (err * err, F.col("fwd") * F.col("fwd")))


@query("sta_04_directional", dm_sql("case when sign(score)=sign(fwd) then 0.0 else 1.0 end", "case when fwd>0 then 0.0 else 1.0 end"))
def sta_04_directional(spark, sf_dir):
    """Wrong directions of the score against those of always saying up."""
    return _compared(shared.stored(_spans(spark, sf_dir)), sig.direction_losses(F.col("score"), F.col("fwd")))


@query(
    "agg_25_skill_p_values",
    f"""with {INDEXED_SQL}, hz as (select symbol, i, {lag(0)}/{lag(20)}-1 as score, unnest([1, 5, 21]) as h, unnest([{", ".join(f"lead(close, {h}) over w/close-1" for h in _SPANS)}]) as fwd from ix{WIN}),
s as materialized (select * from (select *, unnest([true, false]) as every from hz where score is not null and fwd is not null) where every or i%h=0),
rk as (select *, rank() over (partition by h, every order by score)+(count(*) over (partition by h, every, score)-1)/2.0 as rs, rank() over (partition by h, every order by fwd)+(count(*) over (partition by h, every, fwd)-1)/2.0 as rf from s),
g as (select h, every, count(*) as n, count(*) filter (sign(score)=sign(fwd)) as hits, corr(score, fwd) as pearson, corr(rs, rf) as spearman, corr(score, fwd)*sqrt((count(*)-2)/(1-power(corr(score, fwd), 2))) as tp, corr(rs, rf)*sqrt((count(*)-2)/(1-power(corr(rs, rf), 2))) as ts from rk group by 1, 2),
b as (select h, every, count(*) filter (acc>0.5) as symbols_above from (select h, every, symbol, avg(case when sign(score)=sign(fwd) then 1.0 else 0.0 end) as acc from s group by 1, 2, 3) group by 1, 2)
select h, every, n, hits, {r6('pearson')} as pearson, {r6(t_two_sided_sql('tp', '(n-2)'))} as pearson_p, {r6('spearman')} as spearman, {r6(t_two_sided_sql('ts', '(n-2)'))} as spearman_p, {r6(binomial_two_sided_sql('hits', 'n'))} as binomial_p, symbols_above from g join b using (h, every)""",
)
def agg_25_skill_p_values(spark, sf_dir):
    """Exact binomial and correlation p-values of the score at three horizons, over all bars and those h apart; one scan of the bars."""
    x = shared.stored(_spans(spark, sf_dir))
    both = F.when(F.col("i") % F.col("h") == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    by = ["h", "every"]
    hit = F.when(F.signum("score") == F.signum("fwd"), 1).otherwise(0)
    # Counts and the plain correlation need no ranks.
    s = x.withColumn("every", F.explode(both)).withColumn("hit", hit)
    ranked = sig.with_average_rank(sig.with_average_rank(s, by, "score", "rs"), by, "fwd", "rf")
    per = ranked.groupBy(*by, "symbol").agg(F.count("*").alias("c"), F.sum("hit").alias("k"))
    above = per.groupBy(*by).agg(F.count_if(2 * F.col("k") > F.col("c")).alias("symbols_above"))
    g = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.corr("score", "fwd").alias("pearson"), F.corr("rs", "rf").alias("spearman")).join(F.broadcast(above), by)
    # Names of their own: a new column of an old name would be taken within the lambdas of the tails.
    p = {"pearson_p": correlation_p(F.col("pearson"), F.col("n")), "spearman_p": correlation_p(F.col("spearman"), F.col("n")), "binomial_p": binomial_two_sided(F.col("hits"), F.col("n"))}
    told = g.select("*", *(v.alias(k) for k, v in p.items()))
    return told.select(*by, "n", "hits", *(rounded(F.col(c)).alias(c) for c in ("pearson", "pearson_p", "spearman", "spearman_p", "binomial_p")), "symbols_above")


@query("sta_06_power", f"with {INDEXED_SQL}, {MARKET_SQL}, j as (select symbol, ret, mret from ix join market using (date) where ret is not null), p as (select symbol, corr(ret,mret) as rho, avg(mret)/stddev_pop(mret) as sb, count(*) as n from j group by symbol) select symbol, {r6('rho')} as rho, cast(ceil(power(1.959964+0.841621,2)*(2-2*rho+0.5*((0.3/sqrt(252.0)+sb)*(0.3/sqrt(252.0)+sb)+sb*sb-2*(0.3/sqrt(252.0)+sb)*sb*rho*rho))/power(0.3/sqrt(252.0),2)) as bigint) as days_needed from p")
def sta_06_power(spark, sf_dir):
    """Days to detect +0.30 Sharpe at 80 % power (Jobson-Korkie with Memmel's correction)."""
    x = m.indexed(spark, sf_dir).join(m.market(spark, sf_dir), "date").filter("ret is not null")
    p = x.groupBy("symbol").agg(F.corr("ret", "mret").alias("rho"), (F.avg("mret") / F.stddev_pop("mret")).alias("sb"))
    gap = 0.3 / 252.0**0.5
    sa = F.col("sb") + gap
    var = 2 - 2 * F.col("rho") + 0.5 * (sa * sa + F.col("sb") * F.col("sb") - 2 * sa * F.col("sb") * F.col("rho") * F.col("rho"))
    return p.select("symbol", rounded(F.col("rho")).alias("rho"), F.ceil((1.959964 + 0.841621) ** 2 * var / gap**2).alias("days_needed"))


@query("sta_08_dgp_parameters", f"with {INDEXED_SQL}, {MARKET_SQL}, j as (select symbol, ret, mret from ix join market using (date) where ret is not null), p as (select symbol, corr(ret,mret) as rho, stddev_pop(ret) as s, avg(ret)/stddev_pop(ret)*sqrt(252.0) as sh from j group by symbol) select {r6('avg(rho)')} as rho, {r6('avg(s)')} as sigma, {r6('avg(sh)')} as sharpe, count(*) as tickers from p")
def sta_08_dgp_parameters(spark, sf_dir):
    x = m.indexed(spark, sf_dir).join(m.market(spark, sf_dir), "date").filter("ret is not null")
    p = x.groupBy("symbol").agg(F.corr("ret", "mret").alias("rho"), F.stddev_pop("ret").alias("s"), (F.avg("ret") / F.stddev_pop("ret") * F.sqrt(F.lit(252.0))).alias("sh"))
    return p.agg(rounded(F.avg("rho")).alias("rho"), rounded(F.avg("s")).alias("sigma"), rounded(F.avg("sh")).alias("sharpe"), F.count("*").alias("tickers"))


@query("sta_09_paired_t", f"with {INDEXED_SQL}, {_STRAT} select symbol, {r6('avg(r-nxt)/stddev_samp(r-nxt)*sqrt(count(*))')} as t, count(*) as n from sg group by symbol having stddev_samp(r-nxt)>0")
def sta_09_paired_t(spark, sf_dir):
    d = F.col("r") - F.col("nxt")
    x = _strategy(spark, sf_dir).groupBy("symbol").agg(rounded(F.avg(d) / F.nullif(F.stddev_samp(d), F.lit(0.0)) * F.sqrt(F.count("*"))).alias("t"), F.count("*").alias("n"))
    return x.filter("t is not null")


@query(
    "sta_09_tests",
    f"""with {INDEXED_SQL}, {_STRAT}, g as (select symbol, count(*) as n, avg(r-nxt)/nullif(stddev_samp(r-nxt), 0)*sqrt(count(*)) as tp, avg(nxt)/nullif(stddev_samp(nxt), 0)*sqrt(count(*)) as t1, count(*) filter (nxt>0) as ups,
  avg(nxt) filter (segment='tune') as ma, avg(nxt) filter (segment='holdout') as mb, var_samp(nxt) filter (segment='tune')/count(*) filter (segment='tune') as va, var_samp(nxt) filter (segment='holdout')/count(*) filter (segment='holdout') as vb,
  count(*) filter (segment='tune') as na, count(*) filter (segment='holdout') as nb from sg group by symbol),
w as (select *, (ma-mb)/sqrt(va+vb) as tw, power(va+vb, 2)/(va*va/(na-1)+vb*vb/(nb-1)) as dw from g)
select symbol, n, {r6('tp')} as paired_t, {r6(t_two_sided_sql('tp', '(n-1)'))} as paired_p, {r6('t1')} as mean_t, {r6(t_two_sided_sql('t1', '(n-1)'))} as mean_p, {r6('tw')} as welch_t, {r6('dw')} as welch_df, {r6(t_two_sided_sql('tw', 'dw'))} as welch_p, ups, {r6(binomial_two_sided_sql('ups', 'n'))} as binomial_p from w""",
)
def sta_09_tests(spark, sf_dir):
    """Of each symbol: strategy against holding (paired), mean return against 0, tuning against holdout bars (Welch), rises against a coin."""
    x = _strategy(spark, sf_dir).select("symbol", (F.col("r") - F.col("nxt")).alias("d"), "nxt", F.when(F.col("segment") == "tune", F.col("nxt")).alias("a"), F.when(F.col("segment") != "tune", F.col("nxt")).alias("b"))
    (tp, dp), (t1, d1), (tw, dw) = sig.one_sample("d"), sig.one_sample("nxt"), sig.welch("a", "b")
    g = x.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("nxt") > 0).alias("ups"), *(c.alias(name) for name, c in (("tp", tp), ("dp", dp), ("t1", t1), ("d1", d1), ("tw", tw), ("dw", dw))))
    p = {name: rounded(t_two_sided(F.col(t), F.col(d))).alias(name) for name, t, d in (("paired_p", "tp", "dp"), ("mean_p", "t1", "d1"), ("welch_p", "tw", "dw"))}
    return g.select(
        "symbol", "n", rounded(F.col("tp")).alias("paired_t"), p["paired_p"], rounded(F.col("t1")).alias("mean_t"), p["mean_p"], rounded(F.col("tw")).alias("welch_t"), rounded(F.col("dw")).alias("welch_df"),
        p["welch_p"], "ups", rounded(binomial_two_sided(F.col("ups"), F.col("n"))).alias("binomial_p"))


@query("dec_07_sizing_arms", f"with {INDEXED_SQL}, {_STRAT}, arms as (select unnest(['full','fixed10','always_in']) as arm), z as (select symbol, arm, case arm when 'full' then e*nxt when 'fixed10' then 0.1*e*nxt else nxt end as x from sg cross join arms) select symbol, arm, {r6('(exp(sum(ln(1+x)))-1)*100')} as total_pct from z group by 1, 2")
def dec_07_sizing_arms(spark, sf_dir):
    """All arms on the same windows; always-in equals buy and hold."""
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), v.alias("x")) for n, v in (("full", F.col("r")), ("fixed10", 0.1 * F.col("r")), ("always_in", F.col("nxt")))]))
    x = _strategy(spark, sf_dir).select("symbol", arms.alias("a")).select("symbol", "a.arm", "a.x")
    return x.groupBy("symbol", "arm").agg(rounded((F.exp(F.sum(F.log(1 + F.col("x")))) - 1) * 100).alias("total_pct"))


@query("srt_08_grid_winner", f"with {INDEXED_SQL}, grid as (select unnest([5,10,20,40]) as look), s as (select symbol, look, i, n, case when close>avg(close) over (partition by symbol, look order by date rows between 39 preceding and current row)*(1+look/1000.0) then 1.0 else 0.0 end as e, lead(close) over (partition by symbol, look order by date)/close-1 as nxt from ix cross join grid), g as (select symbol, look, (exp(sum(ln(1+e*nxt)))-1)*100 as t from s where nxt is not null and i<round_even(n*0.6,0) group by 1,2) select symbol, look, {r6('t')} as tune_pct from g qualify row_number() over (partition by symbol order by t desc, look)=1")
def srt_08_grid_winner(spark, sf_dir):
    """Every grid cell on the tuning segment; the best cell by (return, smallest look)."""
    mean = F.avg("close").over(last(40))
    x = m.indexed(spark, sf_dir).withColumn("mean", mean).withColumn("nxt", ta.forward_return(1)).filter(F.col("nxt").isNotNull() & (F.col("i") < F.bround(F.col("n") * 0.6)))
    cells = x.select("symbol", "nxt", "close", "mean", F.explode(F.array(*map(F.lit, (5, 10, 20, 40)))).alias("look"))
    g = cells.groupBy("symbol", "look").agg(((F.exp(F.sum(F.log(1 + F.when(F.col("close") > F.col("mean") * (1 + F.col("look") / 1000.0), F.col("nxt")).otherwise(0.0)))) - 1) * 100).alias("t"))
    best = g.groupBy("symbol").agg(F.max_by(F.struct("look", "t"), F.struct("t", -F.col("look"))).alias("b"))
    return best.select("symbol", "b.look", rounded(F.col("b.t")).alias("tune_pct"))


@query("dec_06_target_exposure", f"with {INDEXED_SQL}, {_PRED} select symbol, date, {r6('least(greatest((50+score*200-55)/17,0.0),1.0)*0.8*least(greatest(0.01/greatest(sd,1e-8),0.4),1.0)')} as exposure from pp")
def dec_06_target_exposure(spark, sf_dir):
    ramp = clip((50 + F.col("score") * 200 - 55) / 17, 0, 1)
    return _predictions(spark, sf_dir).select("symbol", "date", rounded(ramp * 0.8 * clip(0.01 / F.greatest("sd", F.lit(1e-8)), 0.4, 1)).alias("exposure"))
