"""Queries over bars: window features, indicators, regimes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numeric import clip, rounded
from tidemark.operators import technical as ta
from tidemark.plans.registry import query
from tidemark.sources import market as m
from tidemark.sources.market import BARS_SQL, by_date, INDEXED_SQL, MARKET_SQL, last

W = "over (partition by symbol order by date rows between {} preceding and current row)"


def r6(x: str) -> str:
    return f"floor(({x})*1e6+0.5)/1e6"


def over(n: int) -> str:
    return W.format(n - 1)


def lag(n: int) -> str:
    return f"lag(close, {n}) over w"


WIN = " window w as (partition by symbol order by date)"


@query("src_bars", f"with {BARS_SQL} select * from bars")
def src_bars(spark, sf_dir):
    return m.bars(spark, sf_dir)


@query("src_market_series", f"with {MARKET_SQL} select date, {r6('mret')} as mret, mclose from market")
def src_market_series(spark, sf_dir):
    return m.market(spark, sf_dir).select("date", rounded(F.col("mret")).alias("mret"), "mclose")


@query("win_01_returns", f"with {INDEXED_SQL} select symbol, date, {r6('ret')} as ret, {r6('lead(close,5) over w / close - 1')} as fwd5 from ix{WIN}")
def win_01_returns(spark, sf_dir):
    return m.indexed(spark, sf_dir).select("symbol", "date", rounded(F.col("ret")).alias("ret"), rounded(ta.forward_return(5)).alias("fwd5"))


_MOM = ", ".join(f"{r6(f'close/{lag(n)}-1')} as mom{n}" for n in (1, 5, 10, 20, 21, 63, 126))


@query("win_02_momentum", f"with {INDEXED_SQL} select symbol, date, {_MOM}, case when i>=253 then {r6(f'{lag(21)}/{lag(251)}-1')} end as mom12_1 from ix{WIN}")
def win_02_momentum(spark, sf_dir):
    x = m.indexed(spark, sf_dir)
    return x.select("symbol", "date", *[rounded(ta.momentum(n)).alias(f"mom{n}") for n in (1, 5, 10, 20, 21, 63, 126)], rounded(ta.momentum_12_1()).alias("mom12_1"))


@query("win_03_sma", f"with {INDEXED_SQL} select symbol, date, " + ", ".join(f"case when i>={n - 1} then floor(avg(close) {over(n)}*1e8+0.5)/1e8 end as sma{n}" for n in (5, 20, 50, 200)) + " from ix")
def win_03_sma(spark, sf_dir):
    return m.indexed(spark, sf_dir).select("symbol", "date", *[rounded(ta.sma(n), 8).alias(f"sma{n}") for n in (5, 20, 50, 200)])


_LISTS = INDEXED_SQL + ", ls as (select symbol, max(i) as last_i, list(close order by date) as cs, list(close-coalesce(prev, close) order by date) as ds, list(ret order by date) filter (ret is not null) as rs from (select *, lag(close) over (partition by symbol order by date) as prev from ix) group by symbol)"


def _fold(values: str, k: str) -> str:
    return f"list_reduce({values}, lambda a, v: v*{k}+a*(1-{k}))"


def _ema_sql(n: int) -> str:
    return _fold(f"list_concat([list_avg(cs[1:{n}])], cs[{n + 1}:])", f"(2.0/{n + 1})")


@query("win_04_ema", f"with {_LISTS} select symbol, {r6(_ema_sql(12))} as ema12, {r6(_ema_sql(26))} as ema26 from ls where last_i>=25")
def win_04_ema(spark, sf_dir):
    x = ta.recursive_indicators(m.indexed(spark, sf_dir))
    return x.filter("i >= 25").groupBy("symbol").agg(rounded(F.max_by("ema12", "i")).alias("ema12"), rounded(F.max_by("ema26", "i")).alias("ema26"))


@query("win_05_ema_flat_start", f"with {INDEXED_SQL} select symbol, {r6('avg(close) filter (i<12)')} as seed, 12 as n_flat from ix group by symbol having count(*)>=12")
def win_05_ema_flat_start(spark, sf_dir):
    x = ta.recursive_indicators(m.indexed(spark, sf_dir)).filter("i < 12")
    return x.groupBy("symbol").agg(rounded(F.max("ema_flat")).alias("seed"), F.count("ema_flat").cast("int").alias("n_flat")).filter("n_flat >= 12")


def _wilder_sql(sign: str) -> str:
    part = f"list_transform(ds[2:], lambda d: greatest({sign}d, 0.0))"
    return f"list_reduce(list_concat([list_avg(({part})[1:14])], ({part})[15:]), lambda a, v: (a*13+v)/14)"


@query("win_06_rsi_wilder", f"with {_LISTS} select symbol, {r6(f'100-100/(1+{_wilder_sql(chr(32))}/{_wilder_sql(chr(45))})')} as rsi from ls where last_i>=15")
def win_06_rsi_wilder(spark, sf_dir):
    x = ta.recursive_indicators(m.indexed(spark, sf_dir)).filter("i >= 15")
    return x.groupBy("symbol").agg(rounded(F.max_by("rsi", "i")).alias("rsi"))


_CHG = "ch as (select *, close-lag(close) over (partition by symbol order by date) as d from ix)"


@query(
    "win_07_rsi_cutler",
    f"with {INDEXED_SQL}, {_CHG} select symbol, date, case when i>=14 then case when avg(greatest(-d,0.0)) {over(14)}=0 then 100.0 else {r6(f'100-100/(1+avg(greatest(d,0.0)) {over(14)}/avg(greatest(-d,0.0)) {over(14)})')} end end as rsi from ch",
)
def win_07_rsi_cutler(spark, sf_dir):
    return ta.with_change(m.indexed(spark, sf_dir)).select("symbol", "date", rounded(ta.rsi_simple()).alias("rsi"))


@query("win_08_rsi_returns", f"with {INDEXED_SQL} select symbol, date, case when i>=14 then {r6(f'(avg(greatest(ret,0.0)) {over(14)}/(avg(greatest(ret,0.0)) {over(14)}+avg(greatest(-ret,0.0)) {over(14)}+1e-9)-0.5)*2')} end as rsi from ix")
def win_08_rsi_returns(spark, sf_dir):
    return m.indexed(spark, sf_dir).select("symbol", "date", rounded(ta.rsi_returns()).alias("rsi"))


@query(
    "win_09_macd",
    f"""with recursive {INDEXED_SQL}, im as materialized (select symbol, i, close from ix), seeds as (select symbol, avg(close) filter (i<12) as s12, avg(close) filter (i<26) as s26 from im group by symbol having count(*)>=40),
    f12 as (select symbol, cast(11 as bigint) as i, s12 as v from seeds union all select x.symbol, x.i, x.close*(2.0/13)+f12.v*(1-2.0/13) from f12 join im x on x.symbol=f12.symbol and x.i=f12.i+1),
    f26 as (select symbol, cast(25 as bigint) as i, s26 as v from seeds union all select x.symbol, x.i, x.close*(2.0/27)+f26.v*(1-2.0/27) from f26 join im x on x.symbol=f26.symbol and x.i=f26.i+1),
    lines as materialized (select x.symbol, x.i, f12.v as f, f26.v as s, coalesce(f12.v-f26.v, 0) as line from im x left join f12 using (symbol, i) left join f26 using (symbol, i)),
    e as (select symbol, cast(0 as bigint) as i, cast(null as double) as f, cast(null as double) as s, cast(0 as double) as acc, cast(null as double) as sig from seeds
      union all
      select b.symbol, b.i, b.f, b.s, case when b.i<9 then e.acc+b.line else e.acc end,
             case when b.i<8 then null when b.i=8 then (e.acc+b.line)/9 else b.line*0.2+e.sig*0.8 end
      from e join lines b on b.symbol=e.symbol and b.i=e.i+1)
    select symbol, {r6('f-s')} as macd, {r6('sig')} as signal, {r6('f-s-sig')} as hist from (select *, row_number() over (partition by symbol order by i desc) as rk from e) where rk=1""",
)
def win_09_macd(spark, sf_dir):
    x = ta.recursive_indicators(m.indexed(spark, sf_dir).filter("n >= 40"))
    return x.groupBy("symbol").agg(*[rounded(F.max_by(c, "i")).alias(c) for c in ("macd", "signal", "hist")])


@query(
    "win_11_bollinger",
    f"with {INDEXED_SQL} select symbol, date, case when i>=19 then {r6(f'avg(close) {over(20)}')} end as mid, case when i>=19 then {r6(f'avg(close) {over(20)}+2*stddev_pop(close) {over(20)}')} end as upper, case when i>=19 then {r6(f'avg(close) {over(20)}-2*stddev_pop(close) {over(20)}')} end as lower from ix",
)
def win_11_bollinger(spark, sf_dir):
    mid, upper, lower = ta.bollinger()
    return m.indexed(spark, sf_dir).select("symbol", "date", rounded(mid).alias("mid"), rounded(upper).alias("upper"), rounded(lower).alias("lower"))


@query(
    "win_12_percent_b",
    f"with {INDEXED_SQL}, s as (select *, avg(close) {over(20)} as a, stddev_pop(close) {over(20)} as sd from ix) select symbol, date, case when i<19 or sd<1e-9 then 0.0 else {r6('least(greatest((close-a)/(2*sd),-2.0),2.0)')} end as pct_b from s",
)
def win_12_percent_b(spark, sf_dir):
    return m.indexed(spark, sf_dir).select("symbol", "date", F.when((F.col("i") < 19), 0.0).otherwise(rounded(ta.percent_b())).alias("pct_b"))


_MKT5 = f"mk as (select x.*, last_value(mclose ignore nulls) over (partition by symbol order by date rows between unbounded preceding and current row) as mc from ix x left join market using (date))"


@query(
    "win_13_relative_momentum",
    f"with {INDEXED_SQL}, {MARKET_SQL}, {_MKT5} select symbol, date, case when lag(mc,5) over w is not null then {r6('least(greatest((close/lag(close,5) over w-1)-(mc/lag(mc,5) over w-1),-0.5),0.5)')} end as rel5 from mk{WIN}",
)
def win_13_relative_momentum(spark, sf_dir):
    x = m.indexed(spark, sf_dir).join(m.market(spark, sf_dir), "date", "left")
    x = x.withColumn("mc", F.last("mclose", ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0)))
    own, other = ta.momentum(5), F.col("mc") / F.lag("mc", 5).over(by_date()) - 1
    return x.select("symbol", "date", F.when((own - other).isNotNull(), rounded(clip(own - other, -0.5, 0.5))).alias("rel5"))


@query("join_01_market_ffill", f"with {INDEXED_SQL}, {MARKET_SQL}, {_MKT5} select symbol, date, close, mc from mk")
def join_01_market_ffill(spark, sf_dir):
    x = m.indexed(spark, sf_dir).join(m.market(spark, sf_dir), "date", "left")
    return x.select("symbol", "date", "close", F.last("mclose", ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0)).alias("mc"))


@query(
    "win_14_volume_ratio",
    f"with {INDEXED_SQL} select symbol, date, case when count(volume) {over(20)}=20 then {r6(f'least(greatest(ln(volume/avg(volume) {over(20)}),-1.5),1.5)')} else 0.0 end as log_ratio, {r6(f'avg(volume) {over(20)}/avg(volume) {over(63)}')} as surge from ix",
)
def win_14_volume_ratio(spark, sf_dir):
    x = m.indexed(spark, sf_dir)
    return x.select(
        "symbol", "date", F.when(F.count("volume").over(last(20)) == 20, rounded(ta.volume_log_ratio())).otherwise(0.0).alias("log_ratio"),
        rounded(F.avg("volume").over(last(20)) / F.avg("volume").over(last(63))).alias("surge"),
    )


@query(
    "win_16_range_position",
    f"with {INDEXED_SQL}, s as (select *, max(close) {over(20)} as hi, min(close) {over(20)} as lo from ix) select symbol, date, {r6('close/hi-1')} as from_high, case when hi>lo then {r6('(close-lo)/(hi-lo)-0.5')} else 0.0 end as position from s",
)
def win_16_range_position(spark, sf_dir):
    high, place = ta.range_features()
    return m.indexed(spark, sf_dir).select("symbol", "date", rounded(high).alias("from_high"), rounded(place).alias("position"))


@query(
    "win_18_features",
    f"""with {INDEXED_SQL}, tr as (select *, greatest(high-low, abs(high-{lag(1)}), abs(low-{lag(1)})) as tr, ret-lag(ret) over w as dr, lag(ret) over w as r1 from ix{WIN}),
    mo as (select *, avg(ret) {over(63)} as m1, avg(ret*ret) {over(63)} as m2, avg(ret*ret*ret) {over(63)} as m3 from tr)
    select symbol, date, {r6(f'stddev_pop(ret) {over(21)}')} as vol21, {r6(f'stddev_pop(ret) {over(63)}')} as vol63,
      {r6(f'close/avg(close) {over(20)}-1')} as ma20_ratio, {r6(f'close/avg(close) {over(50)}-1')} as ma50_ratio,
      {r6('close/max(close) over (partition by symbol order by date rows between unbounded preceding and current row)-1')} as drawdown,
      {r6(f'avg(case when ret>0 then 1.0 else 0.0 end) {over(21)}')} as updays, {r6(f'avg(tr) {over(14)}/close')} as atr,
      case when m2-m1*m1>1e-12 then {r6('(m3-3*m1*m2+2*m1*m1*m1)/power(m2-m1*m1,1.5)')} else 0.0 end as skew63
    from mo qualify i>=63""",
)
def win_18_features(spark, sf_dir):
    x = m.indexed(spark, sf_dir).withColumn("tr", ta.true_range())
    m1, m2, m3 = (F.avg(e).over(last(63)) for e in (F.col("ret"), F.col("ret") * F.col("ret"), F.col("ret") * F.col("ret") * F.col("ret")))
    x = x.withColumn("m1", m1).withColumn("m2", m2).withColumn("m3", m3)
    var = F.col("m2") - F.col("m1") * F.col("m1")
    skew = (F.col("m3") - 3 * F.col("m1") * F.col("m2") + 2 * F.col("m1") * F.col("m1") * F.col("m1")) / F.pow(F.greatest(var, F.lit(1e-12)), 1.5)
    out = x.select(
        "symbol", "date", "i", rounded(F.stddev_pop("ret").over(last(21))).alias("vol21"), rounded(F.stddev_pop("ret").over(last(63))).alias("vol63"),
        rounded(F.col("close") / F.avg("close").over(last(20)) - 1).alias("ma20_ratio"), rounded(F.col("close") / F.avg("close").over(last(50)) - 1).alias("ma50_ratio"),
        rounded(ta.drawdown()).alias("drawdown"), rounded(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).over(last(21))).alias("updays"),
        rounded(F.avg("tr").over(last(14)) / F.col("close")).alias("atr"), F.when(var > 1e-12, rounded(skew)).otherwise(0.0).alias("skew63"),
    )
    return out.filter("i >= 63").drop("i")


_REG = f"""vs as (select *, case when i>=21 then stddev_pop(ret) {over(21)} end as sd, regr_slope(ln(close), i) {over(63)} as slope,
   close/max(close) over (partition by symbol order by date rows between unbounded preceding and current row)-1 as dd from ix)"""


@query(
    "win_19_regime",
    f"""with {INDEXED_SQL}, {_REG}, pc as (select a.symbol, a.i, avg(case when b.sd<a.sd-1e-9 then 1.0 else 0.0 end) as pct from vs a join vs b on a.symbol=b.symbol and b.i between a.i-251 and a.i and b.sd is not null where a.i=a.n-1 group by 1,2)
    select symbol, {r6('sd')} as sd, {r6('pct')} as pct, {r6('slope')} as slope, {r6('dd')} as dd,
      case when dd<=-0.15 and pct>=0.8 then 'crisis' when pct>=0.8 then 'volatile' when slope>0 then 'uptrend' else 'downtrend' end as regime
    from vs join pc using (symbol, i)""",
)
def win_19_regime(spark, sf_dir):
    x = m.indexed(spark, sf_dir).withColumn("sd", ta.realised_vol(21))
    x = x.withColumn("slope", F.regr_slope(F.log("close"), F.col("i")).over(last(63))).withColumn("dd", ta.drawdown()).withColumn("past", F.collect_list("sd").over(last(252)))
    x = x.filter("i = n - 1").withColumn("pct", F.size(F.filter("past", lambda v: v < F.col("sd") - 1e-9)) / F.size("past"))
    pct = F.col("pct")
    label = F.when((F.col("dd") <= -0.15) & (pct >= 0.8), "crisis").when(pct >= 0.8, "volatile").when(F.col("slope") > 0, "uptrend").otherwise("downtrend")
    return x.filter(F.size("past") > 0).select("symbol", rounded(F.col("sd")).alias("sd"), rounded(pct).alias("pct"), rounded(F.col("slope")).alias("slope"), rounded(F.col("dd")).alias("dd"), label.alias("regime"))


@query("win_20_drawdown", f"with {INDEXED_SQL} select symbol, date, max(close) over (partition by symbol order by date rows between unbounded preceding and current row) as peak, {r6('close/max(close) over (partition by symbol order by date rows between unbounded preceding and current row)-1')} as drawdown from ix")
def win_20_drawdown(spark, sf_dir):
    return m.indexed(spark, sf_dir).select("symbol", "date", F.max("close").over(by_date().rowsBetween(Window.unboundedPreceding, 0)).alias("peak"), rounded(ta.drawdown()).alias("drawdown"))


@query("win_21_equity", f"with {INDEXED_SQL} select symbol, date, floor(exp(sum(ln(1+coalesce(ret,0.0))) over (partition by symbol order by date))*1e6+0.5001)/1e6 as equity from ix")
def win_21_equity(spark, sf_dir):
    growth = F.exp(F.sum(F.log(1 + F.coalesce("ret", F.lit(0.0)))).over(by_date()))
    return m.indexed(spark, sf_dir).select("symbol", "date", (F.floor(growth * 1e6 + 0.5001) / 1e6).alias("equity"))


@query("win_22_realised_vol", f"with {INDEXED_SQL} select symbol, date, case when i>=21 then {r6('stddev_pop(ret) over (partition by symbol order by date rows between 20 preceding and 1 preceding)')} end as rv20 from ix")
def win_22_realised_vol(spark, sf_dir):
    return m.indexed(spark, sf_dir).select("symbol", "date", rounded(ta.realised_vol(20, inclusive=False)).alias("rv20"))


_SIG = f"sg as (select *, avg(close) {over(20)} as fast, avg(close) {over(50)} as slow, lead(close) over w/close-1 as nxt from ix{WIN}), ex as (select *, case when i>=49 and fast>slow then 1.0 else 0.0 end as e from sg)"


@query(
    "win_23_sma_crossover",
    f"with {INDEXED_SQL}, {_SIG}, tr as (select *, abs(e-coalesce(lag(e) over w,0.0)) as t from ex{WIN}) select symbol, {r6('exp(sum(ln(1+e*nxt)))-1')} as total, cast(sum(case when t>0 then 1 else 0 end) as bigint) as trades, {r6('avg(e)')} as exposure from tr where nxt is not null group by symbol",
)
def win_23_sma_crossover(spark, sf_dir):
    x = m.indexed(spark, sf_dir)
    fast, slow = F.avg("close").over(last(20)), F.avg("close").over(last(50))
    x = x.withColumn("e", F.when((F.col("i") >= 49) & (fast > slow), 1.0).otherwise(0.0)).withColumn("nxt", ta.forward_return(1))
    x = x.withColumn("t", F.abs(F.col("e") - F.coalesce(F.lag("e").over(by_date()), F.lit(0.0)))).filter("nxt is not null")
    return x.groupBy("symbol").agg(rounded(F.exp(F.sum(F.log(1 + F.col("e") * F.col("nxt")))) - 1).alias("total"), F.count_if(F.col("t") > 0).alias("trades"), rounded(F.avg("e")).alias("exposure"))


@query("win_24_tsmom", f"with {INDEXED_SQL} select symbol, date, case when {lag(21)}/{lag(273)}-1>0 then 1 else 0 end as signal from ix{WIN} qualify {lag(273)} is not null")
def win_24_tsmom(spark, sf_dir):
    x = m.indexed(spark, sf_dir).withColumn("past", F.lag("close", 273).over(by_date())).withColumn("near", F.lag("close", 21).over(by_date()))
    return x.filter("past is not null").select("symbol", "date", F.when(F.col("near") / F.col("past") - 1 > 0, 1).otherwise(0).alias("signal"))


_VT = "vt as (select *, case when i>=21 then stddev_pop(ret) over (partition by symbol order by date rows between 20 preceding and 1 preceding) end as rv from ix)"


@query(
    "win_25_vol_target",
    f"with {INDEXED_SQL}, {_VT}, e as (select *, least(greatest(0.01/greatest(rv,1e-8),0.0),1.5) as ex from vt where rv is not null) select symbol, date, {r6('ex')} as exposure, {r6('coalesce(lag(ex) over w, ex)')} as lagged, {r6('avg(ex) over (partition by symbol)')} as matched from e{WIN}",
)
def win_25_vol_target(spark, sf_dir):
    x = m.indexed(spark, sf_dir).withColumn("rv", ta.realised_vol(20, inclusive=False)).filter("rv is not null")
    x = x.withColumn("ex", clip(0.01 / F.greatest("rv", F.lit(1e-8)), 0, 1.5))
    return x.select("symbol", "date", rounded(F.col("ex")).alias("exposure"), rounded(F.coalesce(F.lag("ex").over(by_date()), F.col("ex"))).alias("lagged"), rounded(F.avg("ex").over(ta.all_bars())).alias("matched"))


@query(
    "win_26_simulate",
    f"with {INDEXED_SQL}, {_SIG}, s as (select symbol, e*nxt+(1-e)*0.04/252-0.001*abs(e-coalesce(lag(e) over w,0.0)) as net, nxt from ex{WIN}) select symbol, {r6('sum(net)')} as net, {r6('avg(net)*252')} as yearly from s where nxt is not null group by symbol",
)
def win_26_simulate(spark, sf_dir):
    x = m.indexed(spark, sf_dir)
    x = x.withColumn("e", F.when((F.col("i") >= 49) & (F.avg("close").over(last(20)) > F.avg("close").over(last(50))), 1.0).otherwise(0.0)).withColumn("nxt", ta.forward_return(1))
    turn = F.abs(F.col("e") - F.coalesce(F.lag("e").over(by_date()), F.lit(0.0)))
    x = x.withColumn("net", F.col("e") * F.col("nxt") + (1 - F.col("e")) * 0.04 / 252 - 0.001 * turn).filter("nxt is not null")
    return x.groupBy("symbol").agg(rounded(F.sum("net")).alias("net"), rounded(F.avg("net") * 252).alias("yearly"))


@query("win_30_ewma_variance", f"with {_LISTS} select symbol, floor({_fold('list_concat([list_var_pop(rs[1:22])], list_transform(rs[23:], lambda r: r*r))', '0.06')}*1e10+0.5)/1e10 as ewma_var from ls where last_i>=25")
def win_30_ewma_variance(spark, sf_dir):
    x = ta.recursive_indicators(m.indexed(spark, sf_dir)).filter("i >= 25")
    return x.groupBy("symbol").agg(rounded(F.max_by("ewma_var", "i"), 10).alias("ewma_var"))


@query("win_31_variance_forecasts", f"with {INDEXED_SQL} select symbol, date, floor(var_pop(ret) {over(21)}*1e10+0.5)/1e10 as rw, floor(var_pop(ret) over (partition by symbol order by date rows between unbounded preceding and current row)*1e10+0.5)/1e10 as mean_var from ix qualify i>=21")
def win_31_variance_forecasts(spark, sf_dir):
    x = m.indexed(spark, sf_dir)
    x = x.select("symbol", "date", "i", rounded(F.var_pop("ret").over(last(21)), 10).alias("rw"), rounded(F.var_pop("ret").over(by_date().rowsBetween(Window.unboundedPreceding, 0)), 10).alias("mean_var"))
    return x.filter("i >= 21").drop("i")


@query("win_34_forecast_grid", f"with {INDEXED_SQL} select symbol, i, date, close from ix where i>=500 and i<n-21 and (i-500)%21=0")
def win_34_forecast_grid(spark, sf_dir):
    return m.indexed(spark, sf_dir).filter("i >= 500 and i < n - 21 and (i - 500) % 21 = 0").select("symbol", F.col("i").cast("long").alias("i"), "date", "close")


@query(
    "win_35_cross_rank",
    f"with {INDEXED_SQL}, s as (select symbol, date, close/{lag(21)}-1 as mom from ix{WIN}) select symbol, date, {r6('(row_number() over (partition by date order by mom, symbol)-1)/greatest(count(*) over (partition by date)-1, 1)')} as pct from s where mom is not null",
)
def win_35_cross_rank(spark, sf_dir):
    x = m.indexed(spark, sf_dir).withColumn("mom", ta.momentum(21)).filter("mom is not null")
    day = Window.partitionBy("date")
    return x.select("symbol", "date", rounded((F.row_number().over(day.orderBy("mom", "symbol")) - 1) / F.greatest(F.count("*").over(day) - 1, F.lit(1))).alias("pct"))


@query("win_36_support_resistance", f"with {INDEXED_SQL} select symbol, date, min(close) {over(15)} as support, max(close) {over(15)} as resistance from ix")
def win_36_support_resistance(spark, sf_dir):
    return m.indexed(spark, sf_dir).select("symbol", "date", F.min("close").over(last(15)).alias("support"), F.max("close").over(last(15)).alias("resistance"))


@query(
    "win_37_today_trend",
    f"""with {INDEXED_SQL}, s as (select symbol, date, i, n, 0.5*(close/{lag(1)}-1)+0.3*(close/{lag(3)}-1)+0.2*(close/{lag(5)}-1) as blend, avg(case when ret>0 then 1.0 else 0.0 end) {over(5)} as up from ix{WIN})
    select symbol, {r6('blend')} as blend, {r6('greatest(up,1-up)')} as consistency, case when blend>0.005 then 'up' when blend<-0.005 then 'down' else 'flat' end as trend from s where i=n-1 and i>=5""",
)
def win_37_today_trend(spark, sf_dir):
    blend = 0.5 * ta.momentum(1) + 0.3 * ta.momentum(3) + 0.2 * ta.momentum(5)
    x = m.indexed(spark, sf_dir).withColumn("blend", blend).withColumn("up", F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).over(last(5))).filter("i = n - 1 and i >= 5")
    return x.select("symbol", rounded(F.col("blend")).alias("blend"), rounded(F.greatest(F.col("up"), 1 - F.col("up"))).alias("consistency"), F.when(F.col("blend") > 0.005, "up").when(F.col("blend") < -0.005, "down").otherwise("flat").alias("trend"))


@query("win_38_horizon_vol", f"with {INDEXED_SQL}, s as (select *, stddev_pop(ret) {over(39)} as sd from ix) select symbol, {r6('sd*sqrt(5.0)*100')} as vol_pct from s where i=n-1")
def win_38_horizon_vol(spark, sf_dir):
    x = m.indexed(spark, sf_dir).withColumn("sd", F.stddev_pop("ret").over(last(39))).filter("i = n - 1")
    return x.select("symbol", rounded(F.col("sd") * F.sqrt(F.lit(5.0)) * 100).alias("vol_pct"))


@query(
    "win_39_market_snapshot",
    f"""with {INDEXED_SQL}, s as (select *, avg(close) {over(5)} as ma5, avg(close) {over(20)} as ma20, stddev_samp(ret) {over(20)} as sd from ix)
    select symbol, {r6('ma5')} as ma5, {r6('ma20')} as ma20, {r6('sd')} as vol20, case when ma5>ma20*1.01 then 'bullish' when ma5<ma20*0.99 then 'bearish' else 'neutral' end as trend from s where i=n-1""",
)
def win_39_market_snapshot(spark, sf_dir):
    x = m.indexed(spark, sf_dir).withColumn("ma5", F.avg("close").over(last(5))).withColumn("ma20", F.avg("close").over(last(20))).withColumn("sd", F.stddev_samp("ret").over(last(20)))
    trend = F.when(F.col("ma5") > F.col("ma20") * 1.01, "bullish").when(F.col("ma5") < F.col("ma20") * 0.99, "bearish").otherwise("neutral")
    return x.filter("i = n - 1").select("symbol", rounded(F.col("ma5")).alias("ma5"), rounded(F.col("ma20")).alias("ma20"), rounded(F.col("sd")).alias("vol20"), trend.alias("trend"))


@query(
    "win_40_market_adapter",
    f"""with {INDEXED_SQL}, s as (select *, avg(close) {over(20)} as ma20, avg(close) {over(50)} as ma50, stddev_samp(ret) {over(60)}*sqrt(252.0) as vol from ix)
    select symbol, {r6('vol')} as vol, case when close>ma20 and ma20>ma50 then 'up' when close<ma20 and ma20<ma50 then 'down' else 'sideways' end as trend from s where i=n-1 and i>=60""",
)
def win_40_market_adapter(spark, sf_dir):
    x = m.indexed(spark, sf_dir).withColumn("ma20", F.avg("close").over(last(20))).withColumn("ma50", F.avg("close").over(last(50))).withColumn("vol", F.stddev_samp("ret").over(last(60)) * F.sqrt(F.lit(252.0)))
    trend = F.when((F.col("close") > F.col("ma20")) & (F.col("ma20") > F.col("ma50")), "up").when((F.col("close") < F.col("ma20")) & (F.col("ma20") < F.col("ma50")), "down").otherwise("sideways")
    return x.filter("i = n - 1 and i >= 60").select("symbol", rounded(F.col("vol")).alias("vol"), trend.alias("trend"))


@query("win_41_rebased", f"with {INDEXED_SQL} select symbol, date, {r6('(close/first_value(close) over w-1)*100')} as pct from ix{WIN}")
def win_41_rebased(spark, sf_dir):
    return m.indexed(spark, sf_dir).select("symbol", "date", rounded((F.col("close") / F.first("close").over(by_date()) - 1) * 100).alias("pct"))


@query("win_43_breach", f"with {INDEXED_SQL} select symbol, date, case when min(close) over (partition by symbol order by date rows between 1 following and 21 following)/close<0.95 then 1 else 0 end as breached from ix where n>21 qualify row_number() over (partition by symbol order by date desc)>21")
def win_43_breach(spark, sf_dir):
    low = F.min("close").over(by_date().rowsBetween(1, 21))
    x = m.indexed(spark, sf_dir).withColumn("low21", low).filter("i < n - 21")
    return x.select("symbol", "date", F.when(F.col("low21") / F.col("close") < 0.95, 1).otherwise(0).alias("breached"))


@query("win_44_momentum_from_array", f"with {_LISTS} select symbol, {r6('cs[-1]/cs[-6]-1')} as momentum from ls where last_i>=5")
def win_44_momentum_from_array(spark, sf_dir):
    x = m.indexed(spark, sf_dir).withColumn("history", F.collect_list("close").over(last(40))).filter("i = n - 1 and i >= 5")
    return x.select("symbol", rounded(F.element_at("history", -1) / F.element_at("history", -6) - 1).alias("momentum"))


@query("src_11_weekly_bars", f"with {BARS_SQL} select symbol, cast(date_trunc('week', date) as date) as week, arg_min(open, date) as open, max(high) as high, min(low) as low, arg_max(close, date) as close, sum(volume) as volume from bars group by 1, 2")
def src_11_weekly_bars(spark, sf_dir):
    b = m.bars(spark, sf_dir)
    return b.groupBy("symbol", F.to_date(F.date_trunc("week", "date")).alias("week")).agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))


@query("src_09_history30", f"with {INDEXED_SQL} select symbol, {r6('(arg_max(close,date)/arg_min(close,date)-1)*100')} as change_pct, max(close) as high, min(close) as low, count(*) as points from ix where i>=n-30 group by symbol having count(*)>=5")
def src_09_history30(spark, sf_dir):
    x = m.indexed(spark, sf_dir).filter("i >= n - 30").groupBy("symbol").agg(rounded((F.max_by("close", "date") / F.min_by("close", "date") - 1) * 100).alias("change_pct"), F.max("close").alias("high"), F.min("close").alias("low"), F.count("*").alias("points"))
    return x.filter("points >= 5")


@query("flt_12_jump_audit", f"with {INDEXED_SQL} select symbol, date, {r6('ret')} as jump from ix where abs(ret)>0.05")
def flt_12_jump_audit(spark, sf_dir):
    return m.indexed(spark, sf_dir).filter(F.abs("ret") > 0.05).select("symbol", "date", rounded(F.col("ret")).alias("jump"))


@query("flt_14_rebalance_calendar", f"with {INDEXED_SQL} select symbol, i, date from ix where i>=least(260,greatest(120,n//3)) and (i-least(260,greatest(120,n//3)))%5=0")
def flt_14_rebalance_calendar(spark, sf_dir):
    x = m.indexed(spark, sf_dir).withColumn("start", F.expr("least(260, greatest(120, n div 3))"))
    return x.filter("i >= start and (i - start) % 5 = 0").select("symbol", F.col("i").cast("long").alias("i"), "date")


@query("flt_15_split_point", f"with {INDEXED_SQL} select symbol, case when i<round_even(n*0.6,0) then 'tune' else 'holdout' end as segment, count(*) as bars, min(date) as first, max(date) as last from ix group by 1, 2")
def flt_15_split_point(spark, sf_dir):
    x = m.indexed(spark, sf_dir).withColumn("segment", F.when(F.col("i") < F.bround(F.col("n") * 0.6), "tune").otherwise("holdout"))
    return x.groupBy("symbol", "segment").agg(F.count("*").alias("bars"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("flt_10_point_in_time", f"with {BARS_SQL} select symbol, max(date) as as_of, count(*) as bars, arg_max(close, date) as close from bars where date<=date '1998-06-30' group by symbol")
def flt_10_point_in_time(spark, sf_dir):
    return m.bars(spark, sf_dir).filter("date <= date'1998-06-30'").groupBy("symbol").agg(F.max("date").alias("as_of"), F.count("*").alias("bars"), F.max_by("close", "date").alias("close"))


@query("join_05_horizon_offset", f"with {INDEXED_SQL} select a.symbol, a.date, a.close, b.date as exit_date, b.close as exit_close, {r6('b.close/a.close-1')} as realised from ix a join ix b on a.symbol=b.symbol and b.i=a.i+5 ")
def join_05_horizon_offset(spark, sf_dir):
    x = m.indexed(spark, sf_dir).withColumn("exit_date", F.lead("date", 5).over(by_date())).withColumn("exit_close", F.lead("close", 5).over(by_date()))
    return x.filter("exit_close is not null").select("symbol", "date", "close", "exit_date", "exit_close", rounded(F.col("exit_close") / F.col("close") - 1).alias("realised"))


@query("join_06_asof", f"with {BARS_SQL}, asks as (select distinct o_orderdate::date as day from orders), s as (select distinct symbol from bars) select s.symbol, a.day, b.date, b.close from asks a cross join s asof join bars b on s.symbol=b.symbol and a.day>=b.date")
def join_06_asof(spark, sf_dir):
    """Latest bar on or before each asked day: bars and questions in one ordered stream per symbol."""
    b = m.bars(spark, sf_dir).select("symbol", "date", "close")
    days = m.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    asks = b.select("symbol").distinct().join(F.broadcast(days.agg(F.collect_set("date").alias("days")))).select("symbol", F.explode("days").alias("date"))
    both = b.withColumn("ask", F.lit(0)).unionByName(asks.select("symbol", "date", F.lit(None).cast("double").alias("close"), F.lit(1).alias("ask")))
    so_far = Window.partitionBy("symbol").orderBy("date", "ask").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("bar", F.last(F.when(F.col("ask") == 0, F.struct("date", "close")), ignorenulls=True).over(so_far))
    return found.filter("ask = 1 and bar is not null").select("symbol", F.col("date").alias("day"), "bar.date", "bar.close")
