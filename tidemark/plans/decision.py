"""Queries of the decision layer: evidence, weights, fusion, recommendation, risk gates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numeric import clip, norm_cdf, norm_cdf_sql, rounded
from tidemark.operators import technical as ta
from tidemark.plans.registry import query
from tidemark.plans.technical import WIN, lag, over, r6
from tidemark.sources import market as m
from tidemark.sources.market import INDEXED_SQL, last

# One row per symbol and bar, with what the agents know at that close.
_EV = f"ev0 as (select symbol, date, i, n, close, ret, close/{lag(20)}-1 as mom, stddev_pop(ret) {over(21)} as sd, avg(close) {over(30)} as ma30, lead(close,5) over w/close-1 as fwd from ix{WIN}), ev as (select * from ev0 where i>=60)"
_HEAD = f"with {INDEXED_SQL}, {_EV}"


def evidence(spark, sf_dir):
    x = m.indexed(spark, sf_dir)
    x = x.withColumn("mom", ta.momentum(20)).withColumn("sd", F.stddev_pop("ret").over(last(21))).withColumn("ma30", F.avg("close").over(last(30))).withColumn("fwd", ta.forward_return(5))
    return x.filter("i >= 60")


_RISK = "case when sd*1.645>=0.8*0.05 then 'high' when sd*1.645>=0.45*0.05 then 'medium' else 'low' end"
_SIZE = "greatest(2.0, 20*(1-least(2.2*sd*1.645,0.08)))"


@query("dec_01_risk_gate", _HEAD + f" select symbol, date, {_RISK} as level, {r6(_SIZE)} as position_pct from ev")
def dec_01_risk_gate(spark, sf_dir):
    var = F.col("sd") * 1.645
    level = F.when(var >= 0.8 * 0.05, "high").when(var >= 0.45 * 0.05, "medium").otherwise("low")
    return evidence(spark, sf_dir).select("symbol", "date", level.alias("level"), rounded(F.greatest(F.lit(2.0), 20 * (1 - F.least(2.2 * var, F.lit(0.08))))).alias("position_pct"))


@query("dec_02_invalidating_factors", _HEAD + ", f as (select symbol, date, list_filter([case when sd>0.03 then 'volatile' end, case when mom<-0.1 then 'falling' end, case when close<ma30 then 'below trend' end], lambda x: x is not null) as fs from ev) select symbol, date, len(fs) as factors, array_to_string(fs, '; ') as reasons, greatest(-0.3, -0.1*len(fs)) as confidence_adj from f")
def dec_02_invalidating_factors(spark, sf_dir):
    fs = F.array_compact(F.array(F.when(F.col("sd") > 0.03, "volatile"), F.when(F.col("mom") < -0.1, "falling"), F.when(F.col("close") < F.col("ma30"), "below trend")))
    x = evidence(spark, sf_dir).withColumn("fs", fs)
    return x.select("symbol", "date", F.size("fs").cast("long").alias("factors"), F.array_join("fs", "; ").alias("reasons"), F.greatest(F.lit(-0.3), F.lit(-0.1) * F.size("fs")).alias("confidence_adj"))


@query("dec_03_verification", _HEAD + " select symbol, date, case when mom>0.05 and close<ma30 then 'conflict' when sd>0.03 then 'warning' else 'ok' end as status from ev")
def dec_03_verification(spark, sf_dir):
    status = F.when((F.col("mom") > 0.05) & (F.col("close") < F.col("ma30")), "conflict").when(F.col("sd") > 0.03, "warning").otherwise("ok")
    return evidence(spark, sf_dir).select("symbol", "date", status.alias("status"))


_TREND = "least(greatest(50+(close/ma30-1)/0.05*50, 0), 100)"


@query("dec_04_trend_subscore", _HEAD + f" select symbol, date, {r6(_TREND)} as subscore from ev")
def dec_04_trend_subscore(spark, sf_dir):
    return evidence(spark, sf_dir).select("symbol", "date", rounded(clip(50 + (F.col("close") / F.col("ma30") - 1) / 0.05 * 50, 0, 100)).alias("subscore"))


_AGENTS = "ag as (select symbol, date, fwd, 'market' as agent, case when close>ma30 then 'up' else 'down' end as direction, 0.6 as conf, 4.0 as age, 24.0 as hl from ev union all select symbol, date, fwd, 'analyst', case when mom>0.02 then 'up' when mom<-0.02 then 'down' else 'flat' end, 0.5+least(abs(mom),0.4), 10.0, 48.0 from ev union all select symbol, date, fwd, 'risk', null, 0.8, 100.0, 2160.0 from ev)"
_RAW = "raw as (select *, conf*power(case agent when 'market' then 0.55 when 'analyst' then 0.6 else 0.5 end, 1.5)*sqrt(greatest(0.2, power(0.5, age/hl))) as w from ag)"


def agents(spark, sf_dir):
    """Evidence rows of three agents per decision; risk has no direction."""
    mom = F.col("mom")
    rows = F.array(
        F.struct(F.lit("market").alias("agent"), F.when(F.col("close") > F.col("ma30"), "up").otherwise("down").alias("direction"), F.lit(0.6).alias("conf"), F.lit(4.0).alias("age"), F.lit(24.0).alias("hl"), F.lit(0.55).alias("rel")),
        F.struct(F.lit("analyst").alias("agent"), F.when(mom > 0.02, "up").when(mom < -0.02, "down").otherwise("flat").alias("direction"), (0.5 + F.least(F.abs(mom), F.lit(0.4))).alias("conf"), F.lit(10.0).alias("age"), F.lit(48.0).alias("hl"), F.lit(0.6).alias("rel")),
        F.struct(F.lit("risk").alias("agent"), F.lit(None).cast("string").alias("direction"), F.lit(0.8).alias("conf"), F.lit(100.0).alias("age"), F.lit(2160.0).alias("hl"), F.lit(0.5).alias("rel")),
    )
    x = evidence(spark, sf_dir).select("symbol", "date", "fwd", F.explode(rows).alias("a")).select("symbol", "date", "fwd", "a.*")
    return x.withColumn("w", F.col("conf") * F.pow("rel", F.lit(1.5)) * F.sqrt(F.greatest(F.lit(0.2), F.pow(F.lit(0.5), F.col("age") / F.col("hl")))))


@query("dec_11_optimizer_screen", _HEAD + f", {_AGENTS} select symbol, date, count(*) filter (direction='up')>0 and count(*) filter (direction='down')>0 as conflict, string_agg(direction, ',' order by agent) as votes from ag group by 1, 2")
def dec_11_optimizer_screen(spark, sf_dir):
    votes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("direction").isNotNull(), F.struct("agent", "direction")))), lambda v: v["direction"]), ",")
    up, down = (F.count_if(F.col("direction") == d) > 0 for d in ("up", "down"))
    return agents(spark, sf_dir).groupBy("symbol", "date").agg((up & down).alias("conflict"), votes.alias("votes"))


@query("dec_17_realised_direction", _HEAD + " select symbol, date, case when fwd>0.0005 then 'up' when fwd<-0.0005 then 'down' else 'flat' end as realised from ev where fwd is not null")
def dec_17_realised_direction(spark, sf_dir):
    return evidence(spark, sf_dir).filter("fwd is not null").select("symbol", "date", F.when(F.col("fwd") > 0.0005, "up").when(F.col("fwd") < -0.0005, "down").otherwise("flat").alias("realised"))


@query("mth_01_norm_cdf", _HEAD + f" select symbol, date, {r6(norm_cdf_sql('(mom/greatest(sd*sqrt(20.0),1e-9))'))} as p from ev")
def mth_01_norm_cdf(spark, sf_dir):
    return evidence(spark, sf_dir).select("symbol", "date", rounded(norm_cdf(F.col("mom") / F.greatest(F.col("sd") * F.sqrt(F.lit(20.0)), F.lit(1e-9)))).alias("p"))


_D = "ln(1-0.1)"
_V = "greatest(sd*sqrt(21.0),1e-9)"


@query("mth_02_drawdown_probability", _HEAD + f" select symbol, date, {r6(norm_cdf_sql(f'(({_D}-(mom/20)*21)/{_V})') + '+exp(least(greatest(2*(mom/20)*' + _D + '/greatest(sd*sd,1e-12),-50.0),50.0))*' + norm_cdf_sql(f'(({_D}+(mom/20)*21)/{_V})'))} as p from ev where sd>0.001")
def mth_02_drawdown_probability(spark, sf_dir):
    """First passage below -10 % within 21 bars, with drift."""
    mu, sd = F.col("mom") / 20, F.col("sd")
    vol = F.greatest(sd * F.sqrt(F.lit(21.0)), F.lit(1e-9))
    barrier = F.log(F.lit(1 - 0.1))
    p = norm_cdf((barrier - mu * 21) / vol) + F.exp(clip(2 * mu * barrier / F.greatest(sd * sd, F.lit(1e-12)), -50, 50)) * norm_cdf((barrier + mu * 21) / vol)
    return evidence(spark, sf_dir).filter("sd > 0.001").select("symbol", "date", rounded(p).alias("p"))


_QS = (("p05", -1.645), ("p25", -0.674), ("p50", 0.0), ("p75", 0.674), ("p95", 1.645))


@query("mth_03_distribution", _HEAD + " select symbol, date, " + ", ".join(f"{r6(f'least(greatest(mom/4,-sd/4),sd/4)+{z}*sd*sqrt(5.0)')} as {n}" for n, z in _QS) + " from ev")
def mth_03_distribution(spark, sf_dir):
    sd = F.col("sd")
    mu = F.least(F.greatest(F.col("mom") / 4, -sd / 4), sd / 4)
    return evidence(spark, sf_dir).select("symbol", "date", *[rounded(mu + z * sd * F.sqrt(F.lit(5.0))).alias(n) for n, z in _QS])


@query("mth_04_information_ratio", _HEAD + f" select symbol, date, {r6('mom/20/greatest(sd,1e-9)')} as ir, abs(mom/20/greatest(sd,1e-9))<0.1 as abstain from ev")
def mth_04_information_ratio(spark, sf_dir):
    ir = F.col("mom") / 20 / F.greatest("sd", F.lit(1e-9))
    return evidence(spark, sf_dir).select("symbol", "date", rounded(ir).alias("ir"), (F.abs(ir) < 0.1).alias("abstain"))


@query("mth_14_call_verdict", _HEAD + " select symbol, date, case when fwd is null then 'pending' when mom>0.02 then case when fwd>0.01 then 'right' when fwd<-0.01 then 'wrong' else 'pending' end else case when abs(fwd)<=0.05 then 'right' else 'wrong' end end as verdict from ev")
def mth_14_call_verdict(spark, sf_dir):
    fwd = F.col("fwd")
    buy = F.when(fwd > 0.01, "right").when(fwd < -0.01, "wrong").otherwise("pending")
    return evidence(spark, sf_dir).select("symbol", "date", F.when(fwd.isNull(), "pending").when(F.col("mom") > 0.02, buy).otherwise(F.when(F.abs(fwd) <= 0.05, "right").otherwise("wrong")).alias("verdict"))


@query("agg_18_call_history", _HEAD + f" select symbol, count(*) as calls, count(fwd) as resolved, {r6('avg(case when fwd>0 then 1.0 else 0.0 end) filter (mom>0.02 and fwd is not null)')} as hit_rate, {r6('avg(fwd) filter (mom>0.02)')} as avg_buy_return from ev group by symbol")
def agg_18_call_history(spark, sf_dir):
    buy = (F.col("mom") > 0.02) & F.col("fwd").isNotNull()
    return evidence(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("calls"), F.count("fwd").alias("resolved"), rounded(F.avg(F.when(buy, F.when(F.col("fwd") > 0, 1.0).otherwise(0.0)))).alias("hit_rate"), rounded(F.avg(F.when(buy, F.col("fwd")))).alias("avg_buy_return"))


@query("mdl_09_calibrator", _HEAD + f", p as (select least(cast(floor((1/(1+exp(-20*mom)))*10) as int),9) as bin, case when fwd>0 then 1.0 else 0.0 end as y from ev where fwd is not null), b as (select bin, count(*) as n, avg(y) as rate from p group by bin) select bin, n, case when n<20 then 0.5 else {r6('rate')} end as calibrated from b")
def mdl_09_calibrator(spark, sf_dir):
    """A bin of fewer than 20 observations keeps 0.5."""
    x = evidence(spark, sf_dir).filter("fwd is not null")
    b = x.groupBy(F.least(F.floor(1 / (1 + F.exp(-20 * F.col("mom"))) * 10).cast("int"), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("fwd") > 0, 1.0).otherwise(0.0)).alias("rate"))
    return b.select("bin", "n", F.when(F.col("n") < 20, 0.5).otherwise(rounded(F.col("rate"))).alias("calibrated"))
