"""Queries whose text Spark and DuckDB read alike: decisions, backtest variants, logs, memory, portfolio state.

A text names its inputs in braces; ``both`` registers it with the DataFrames that stand for
them and, for the other engine, with the SQL that builds them.
"""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.operators.places import curated, with_cap, with_place
from tidemark.operators.waves import waves
from tidemark.plans.decision import _EV, evidence
from tidemark.plans.registry import query
from tidemark.plans.technical import r6
from tidemark.sources.market import INDEXED_SQL, QUOTES_SQL, indexed, quotes, table

_BUILT = {"ix": indexed, "ev": evidence, "quotes": quotes}


def doubles(text: str) -> str:
    """Every decimal as a double, which both engines write with an exponent."""
    parts = text.split("'")
    return "'".join(re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) if k % 2 == 0 else p for k, p in enumerate(parts))


def _sha2(text: str) -> str:
    """Spark's hash takes its width as a second argument, at the matching bracket."""
    while (at := text.find("sha(")) >= 0:
        depth, end = 1, at + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}sha2({text[at + 4 : end - 1]}, 256){text[end:]}"
    return text


#: What the two engines write differently: (Spark, DuckDB).
WORDS = {"%SHA%(": ("sha(", "sha256("), "%DAYS%": ("datediff(date '2024-02-20', last_seen)", "date_diff('day', last_seen, date '2024-02-20')"), "%JOIN%": ("array_join(array_sort(collect_list(symbol)), ',')", "string_agg(symbol, ',' order by symbol)")}


def plain_sql(text: str) -> str:
    """The SQL of a text for the other engine, with what builds its inputs."""
    return _for_both(text)[1]


def _for_both(text: str) -> tuple[str, str, list[str], bool]:
    text = doubles(text)
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    heads = [INDEXED_SQL] if {"ix", "ev", "quotes"} & set(names) else []
    heads += [_EV] if "ev" in names else []
    heads += [QUOTES_SQL[len(INDEXED_SQL) + 1 :]] if "quotes" in names else []
    tables = text.lstrip().startswith("select")
    ours, plain = text, re.sub(r"\{(\w+)\}", r"\1", text)
    for word, (here, there) in WORDS.items():
        ours, plain = ours.replace(word, here), plain.replace(word, there)
    ours = _sha2(ours)
    sql = ("with " + ", ".join(heads) + (" " if tables else ", ") + plain) if heads else plain if tables else "with " + plain
    return ours, sql, names, tables


def both(name: str, doc: str, text: str) -> None:
    ours, sql, names, tables = _for_both(text)

    def run(spark, sf_dir):
        frames = {n: (_BUILT[n](spark, sf_dir) if n in _BUILT else table(spark, sf_dir, n)) for n in names}
        return spark.sql(ours if tables else "with " + ours, **frames)

    run.__name__, run.__doc__ = name, doc
    query(name, sql)(run)


def clip(value: str, low: str, high: str) -> str:
    return f"greatest({low}, least({high}, {value}))"


# Weights of the sub-scores, thresholds, dampening by risk, and sizes.
_SIGNALS = f"""a as (select symbol, date, i, n, ret, fwd, i%7<>0 as has_news, i%5<>0 as has_pred, ((i*37)%100)/100.0 as sent, ((i*13)%100)/100.0 as sent_conf, mom*20 as pred_pct, least(0.95, 0.4+abs(mom)*3) as pred_conf, 0.5+(i%5)/10.0 as align,
  45.0+(i%21) as acc, {clip("((i*3)%100)/100.0/0.75", "0.6", "1.3")} as mult_news, {clip("((i*11)%100)/100.0/0.75", "0.6", "1.3")} as mult_pred, close/ma30-1 as gap, sd, sd*1.645 as var,
  case when sd>0.03 then 1 else 0 end+case when mom<-0.1 then 1 else 0 end+case when close<ma30 then 1 else 0 end as factors, mom>0.05 and close<ma30 as conflict from {{ev}}),
b as (select *, 50+(sent-0.5)*2*least(1.0, sent_conf/0.6)*50 as s_news, 50+{clip("pred_pct/1.4", "-1.0", "1.0")}*(0.45+0.55*{clip("(pred_conf-0.5)/0.4", "0.0", "1.0")})*(0.85+0.15*align)*50 as s_pred, 50+{clip("gap/0.05", "-1.0", "1.0")}*50 as s_trend,
  case when has_news then 40*mult_news else 0.0 end as w_news, case when has_pred then 22*mult_pred else 0.0 end as w_pred, case when has_pred then 80.0 else 0.0 end as w_trend, case when var>=0.04 then 'high' when var>=0.0225 then 'medium' else 'low' end as risk from a),
c as (select *, case when w_news+w_pred+w_trend>0 then (s_news*w_news+s_pred*w_pred+s_trend*w_trend)/(w_news+w_pred+w_trend) else 50.0 end as blended from b),
d as (select *, (case when blended>50 then 50+(blended-50)*case risk when 'high' then 0.55 when 'medium' then 0.85 else 1.0 end else blended end)-case when factors>0 then least(0.3, 0.1*factors)*40 else 0.0 end as reasoned from c),
e as (select *, floor({clip(f"case when conflict then {clip('reasoned', '38.0', '62.0')} else reasoned end", "0.0", "100.0")}*100+0.5)/100 as score from d),
f as (select *, not has_news and not has_pred as blind, case when not has_news and not has_pred then 'hold' when score>=63 and (case when has_pred then pred_conf else 0.5 end)>=0.55 and (case when has_pred then acc else 50.0 end)>=52 and risk<>'high' then 'buy' when score<=37 then 'sell' else 'hold' end as action from e)"""

both("dec_05_recommendation", "Reliability-weighted score over the signals at hand, dampened by risk, penalised by invalidating factors, capped on conflict; action, verdict and amount. Without evidence: hold, insufficient_data and no score.", _SIGNALS + f"""
select symbol, date, case when blind then null else {r6('score')} end as score, action, case when blind then 'insufficient_data' when action='buy' then 'buy_now' when action='sell' then 'avoid' else 'wait' end as verdict, risk,
  cast(has_news as int)+2*cast(has_pred as int) as sources, case when action='buy' then floor(10000*greatest(0.0, greatest(2.0, 20*(1-least(2.2*var, 0.08)))/100*(1-0.1*factors))*100+0.5)/100 else 0.0 end as amount from f""")

_VOTES = """ag as (select symbol, date, i, sd, fwd, 'market' as agent, case when close>ma30*1.01 then 'up' when close<ma30*0.99 then 'down' else 'flat' end as direction, 0.6 as conf, cast((i*5)%60 as double) as age, 36.0 as hl from {ev}
  union all select symbol, date, i, sd, fwd, 'analyst', case when mom>0.02 then 'up' when mom<-0.02 then 'down' else 'flat' end, 0.5+least(abs(mom), 0.4), cast((i*7)%90 as double), 48.0 from {ev}
  union all select symbol, date, i, sd, fwd, 'researcher', case when (i*17)%10>6 then 'up' when (i*17)%10<3 then 'down' else 'flat' end, ((i*13)%100)/100.0, cast((i*11)%40 as double), 18.0 from {ev} where i%7<>0
  union all select symbol, date, i, sd, fwd, 'risk', null, 0.8, 100.0, 2160.0 from {ev} where i%11<>0),
hit as (select *, case when direction is null or fwd is null then null when direction=(case when fwd>0.0005 then 'up' when fwd<-0.0005 then 'down' else 'flat' end) then 1.0 else 0.0 end as hit from ag),
rel as (select *, (coalesce(sum(hit) over past, 0.0)+0.5*4)/(count(hit) over past+4) as reliability, least(1.0, greatest(0.2, power(0.5, age/hl))*case when age<24 then 1.15 else 1.0 end) as fresh from hit window past as (partition by symbol, agent order by i rows between unbounded preceding and 6 preceding)),
raw as (select *, greatest(0.01, conf)*power(reliability, 1.5)*sqrt(fresh) as w from rel),
wt as (select *, w/sum(w) over (partition by symbol, date) as weight from raw)"""

both("dec_09_weights", "Confidence, the agent's own past hit rate and freshness make its weight.", _VOTES + f" select symbol, date, agent, {r6('reliability')} as reliability, {r6('fresh')} as fresh, {r6('weight')} as weight from wt")
both("dec_10_fuse", "The vote is renormalised over agents with a direction; the position is scaled by conviction, and none is taken without a risk estimate.", _VOTES + f""",
vt as (select symbol, date, max(sd) as sd, sum(case when direction is not null then weight end) as voting, sum(weight*case direction when 'up' then 1.0 when 'down' then -1.0 when 'flat' then 0.0 end) as total, count(direction) as voters, max(case when agent='risk' then 1 else 0 end) as has_risk from wt group by symbol, date),
sc as (select *, case when voting>0 then total/voting else 0.0 end as s from vt),
ac as (select *, case when s>0.15 then 'buy' when s<-0.15 then 'sell' else 'hold' end as action, greatest(2.0, 20*(1-least(2.2*sd*1.645, 0.08))) as base from sc)
select symbol, date, {r6('s')} as score, action, {r6('least(0.95, abs(s)*1.6)')} as confidence, {r6('voting')} as voting_share, voters, {r6("case when has_risk=0 or action='hold' then 0.0 else base*least(1.0, abs(s)/0.5) end")} as position_pct from ac""")
both("agg_19_agent_hit_rates", "Hit rates of each agent by volatility regime, flat calls scored by the dead band.", _VOTES + """
select agent, case when sd*sqrt(252.0)*100<20 then 'low' when sd*sqrt(252.0)*100<40 then 'mid' else 'high' end as regime, count(*) as n, cast(sum(hit) as bigint) as correct, count(*) filter (where direction='up') as up_calls, count(*) filter (where direction='down') as down_calls, count(*) filter (where direction='flat') as flat_calls from hit where hit is not null group by 1, 2""")
both("add_10_reliability_replay", "Each decision reads the record of those before it; what is recorded does not depend on the decision.", _VOTES + f" select symbol, agent, count(*) as decisions, {r6('avg(reliability)')} as mean_reliability, {r6('max(reliability)')} as best, {r6('min(reliability)')} as worst from rel where direction is not null group by symbol, agent")
both("add_26_provenance", "Newest reading of each usable agent, and its share of evidence and of votes.", _VOTES + f"""
select agent, max(date) as newest, count(*) as readings, {r6('avg(weight)')} as evidence, {r6('avg(case when direction is not null then weight/vote end)')} as votes from (select *, sum(case when direction is not null then weight end) over (partition by symbol, date) as vote from wt) t group by agent""")

_CELLS = _SIGNALS.rpartition(",\nf as")[0]
_EXPOSED = """ex as (select symbol, cell, date, i, n, ret, coalesce(lag(want) over (partition by symbol, cell order by i), 0.0) as expo from want)"""
both("dec_08_ablation", "Score weights of each cell and two references over the same holdout.", _CELLS + f""",
sma as (select symbol, i, avg(close) over (partition by symbol order by date rows between 19 preceding and current row) as fast, avg(close) over (partition by symbol order by date rows between 49 preceding and current row) as slow from {{ix}}),
want as (select symbol, 'full' as cell, date, i, n, ret, {clip("((s_trend*80+s_pred*22)/102-55)/17", "0.0", "1.0")} as want from b union all select symbol, 'trend', date, i, n, ret, {clip("(s_trend-55)/17", "0.0", "1.0")} from b
  union all select symbol, 'prediction', date, i, n, ret, {clip("(s_pred-55)/17", "0.0", "1.0")} from b union all select symbol, 'buy_hold', date, i, n, ret, 1.0 from b union all select b.symbol, 'sma', date, b.i, n, ret, case when fast>slow then 1.0 else 0.0 end from b join sma on b.symbol=sma.symbol and b.i=sma.i),
{_EXPOSED} select cell, count(*) as days, {r6('sqrt(252.0)*avg(expo*ret)/stddev_pop(expo*ret)')} as sharpe, {r6('avg(expo)')} as exposure, {r6('avg(expo*ret)*252*100')} as mean_pct from ex where i>=0.6*n group by cell""")

both("dec_18_exposure_grid", "24 combinations are judged on the first 60 % of bars by symbols that beat holding, then by margins; the winner's holdout is told.", _CELLS + f""",
grid as (select tw, pw, hi, tv from (select explode_tw as tw from (values (34.0), (55.0), (80.0)) as g1(explode_tw)) t1 cross join (values (22.0), (30.0)) as g2(pw) cross join (values (66.0), (72.0)) as g3(hi) cross join (values (0.015), (0.025)) as g4(tv)),
want as (select symbol, cast(tw as varchar(8)) || '/' || cast(pw as varchar(8)) || '/' || cast(hi as varchar(8)) || '/' || cast(tv as varchar(8)) as cell, date, i, n, ret, {clip("((s_trend*tw+s_pred*pw)/(tw+pw)-55)/(hi-55)", "0.0", "1.0")}*least(1.0, tv/greatest(sd, 1e-8)) as want from b cross join grid),
{_EXPOSED},
m as (select symbol, cell, case when i<0.6*n then 'tune' else 'holdout' end as seg, sqrt(252.0)*avg(expo*ret)/nullif(stddev_pop(expo*ret), 0) as sharpe, avg(expo*ret) as mean, sqrt(252.0)*avg(ret)/nullif(stddev_pop(ret), 0) as bh_sharpe, avg(ret) as bh_mean from ex group by 1, 2, 3),
s as (select cell, seg, sum(case when sharpe>bh_sharpe+1e-12 and mean>bh_mean+1e-12 then 1 else 0 end) as beat, avg(sharpe-bh_sharpe) as margin, avg(mean-bh_mean) as ret_margin from m group by 1, 2),
r as (select cell, row_number() over (order by beat desc, {r6('margin')} desc, {r6('ret_margin')} desc, cell) as place from s where seg='tune')
select s.cell, s.seg, cast(s.beat as bigint) as beat, {r6('s.margin')} as margin, cast(r.place as bigint) as place from s join r on s.cell=r.cell""")

_SEGMENT = _CELLS + f""",
want as (select symbol, 'full' as cell, date, i, n, ret, fwd, {clip("((s_trend*80+s_pred*22)/102-55)/17", "0.0", "1.0")} as want from b),
ex as (select symbol, date, i, n, ret, fwd, case when i<0.6*n then 'tune' else 'holdout' end as seg, coalesce(lag(want) over (partition by symbol order by i), 0.0) as expo, want from want),
day as (select *, expo*ret as r, case when abs(expo-coalesce(lag(expo) over (partition by symbol, seg order by i), 0.0))>1e-12 then 1 else 0 end as trade from ex where ret is not null),
eq as (select *, exp(sum(ln(1+r)) over (partition by symbol, seg order by i)) as equity from day),
dd as (select *, equity/greatest(1.0, max(equity) over (partition by symbol, seg order by i))-1 as dd from eq)"""
both("agg_05_segment_metrics", "The metrics of a strategy over one segment: eleven figures.", _SEGMENT + f"""
select symbol, seg, count(*) as days, {r6('(exp(sum(ln(1+r))*252.0/count(*))-1)*100')} as annual_pct, {r6('case when stddev_pop(r)<1e-12 then 0.0 else sqrt(252.0)*avg(r)/stddev_pop(r) end')} as sharpe, {r6('case when coalesce(stddev_pop(case when r<0 then r end), 0.0)<1e-12 then 0.0 else sqrt(252.0)*avg(r)/stddev_pop(case when r<0 then r end) end')} as sortino,
  {r6('least(0.0, min(dd))*100')} as max_drawdown_pct, {r6('avg(expo)')} as exposure, {r6('coalesce(avg(case when expo<>0 then case when r>0 then 100.0 else 0.0 end end), 0.0)')} as win_pct, cast(sum(trade) as bigint) as trades,
  {r6('coalesce(avg(case when want>0.5 and fwd is not null then case when fwd>0 then 100.0 else 0.0 end end), 0.0)')} as buy_hit_pct, count(case when want>0.5 and fwd is not null then 1 end) as buy_signals from dd group by symbol, seg""")

_SMA = """s as (select symbol, date, i, n, ret, close, avg(close) over (partition by symbol order by date rows between 19 preceding and current row) as fast, avg(close) over (partition by symbol order by date rows between 49 preceding and current row) as slow from {ix}),
e as (select *, coalesce(lag(case when i>=49 and fast>slow then 1.0 else 0.0 end) over (partition by symbol order by date), 0.0) as expo from s)"""
both("add_01_sma_segment", "SMA(20/50) on the holdout with four percent a year on cash while flat.", _SMA + f""",
r as (select symbol, expo, expo*ret+0.04/252*(1-expo) as r from e where i>=0.6*n and ret is not null)
select symbol, count(*) as days, {r6('case when stddev_pop(r)<1e-12 then 0.0 else sqrt(252.0)*(avg(r)-0.04/252)/stddev_pop(r) end')} as sharpe, {r6('avg(expo)')} as exposure, {r6('(exp(sum(ln(1+r))*252.0/count(*))-1)*100')} as annual_pct, {r6('coalesce(avg(case when expo<>0 then case when r>0 then 100.0 else 0.0 end end), 0.0)')} as win_pct from r group by symbol""")
both("add_02_momentum_long_short", "Means of the 5 and 20 bars before a bar, one percent apart, go long or short on the next one.", f"""
s as (select symbol, date, i, ret, case when i<20 then 0.0 when avg(close) over (partition by symbol order by date rows between 5 preceding and 1 preceding)>1.01*avg(close) over (partition by symbol order by date rows between 20 preceding and 1 preceding) then 0.1
  when avg(close) over (partition by symbol order by date rows between 5 preceding and 1 preceding)<0.99*avg(close) over (partition by symbol order by date rows between 20 preceding and 1 preceding) then -0.1 else 0.0 end as sig from {{ix}}),
e as (select symbol, i, ret, coalesce(lag(sig) over (partition by symbol order by i), 0.0) as expo from s),
q as (select symbol, i, expo, ret*expo as r, exp(sum(ln(1+ret*expo)) over (partition by symbol order by i)) as equity from e where ret is not null)
select symbol, count(*) as days, {r6('(exp(sum(ln(1+r))*252.0/(count(*)+1))-1)*100')} as annual_pct, {r6('case when stddev_pop(r)<1e-12 then 0.0 else sqrt(252.0)*avg(r)/stddev_pop(r) end')} as sharpe, count(case when expo>0 then 1 end) as long_days, count(case when expo<0 then 1 end) as short_days from q group by symbol""")
both("add_04_rebased_curves", "Equity of holding and of SMA(20/50), both 1 at the first bar of the evaluation; averages warm up on all bars.", _SMA + f""",
z as (select symbol, date, i, ret, expo, case when n>=780 then 260 when n<360 then 120 else cast(floor(n/3) as int) end as st from e)
select symbol, date, {r6('exp(sum(ln(1+ret)) over w)')} as hold, {r6('exp(sum(ln(1+expo*ret)) over w)')} as sma from z where i>st window w as (partition by symbol order by date)""")
_COVERAGE = f"""
p as (select symbol, date, abs(mom) as conf, case when sign(mom)=sign(fwd) then 1 else 0 end as hit from {{ev}} where fwd is not null), k as (select hit, row_number() over (order by conf desc, symbol, date) as place, count(*) over () as total from p),
c as (select cast(share as int) as coverage, count(*) as n, sum(hit) as hits from k cross join (values (100), (50), (25), (10), (5)) as s(share) where place<=ceil(total*share/100.0) group by share)
select coverage, n, {r6('hits*1.0/n')} as accuracy, {r6('(hits*1.0/n+1.9208/n)/(1+3.8416/n)-1.96*sqrt(hits*1.0/n*(1-hits*1.0/n)/n+0.9604/n/n)/(1+3.8416/n)')} as low, {r6('(hits*1.0/n+1.9208/n)/(1+3.8416/n)+1.96*sqrt(hits*1.0/n*(1-hits*1.0/n)/n+0.9604/n/n)/(1+3.8416/n)')} as high from c"""


@query("add_03_coverage_intervals", plain_sql(_COVERAGE))
def add_03_coverage_intervals(spark, sf_dir):
    """Accuracy of the most confident calls by coverage, with Wilson limits; calls are numbered in bands of confidence."""
    p = evidence(spark, sf_dir).filter("fwd is not null").select("symbol", "date", F.abs("mom").alias("conf"), F.when(F.signum("mom") == F.signum("fwd"), 1).otherwise(0).alias("hit"))
    total = p.agg(F.count("*").alias("total"))
    shares = F.explode(F.array(*map(F.lit, (100, 50, 25, 10, 5))))
    k = with_place(p, "conf", "symbol", ["date"]).crossJoin(F.broadcast(total)).withColumn("coverage", shares)  # one row
    c = k.filter("place <= ceil(total * coverage / 100.0D)").groupBy("coverage").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    rate = F.col("hits") / F.col("n")
    centre = (rate + 1.9208 / F.col("n")) / (1 + 3.8416 / F.col("n"))
    reach = 1.96 * F.sqrt(rate * (1 - rate) / F.col("n") + 0.9604 / F.col("n") / F.col("n")) / (1 + 3.8416 / F.col("n"))
    return c.select("coverage", "n", rounded(rate).alias("accuracy"), rounded(centre - reach).alias("low"), rounded(centre + reach).alias("high"))


both("add_09_score_pairs", "Score of a bar with the return from the next close on.", f"w as (select symbol, date, i, mom, lead(close, 6) over (partition by symbol order by i)/lead(close, 1) over (partition by symbol order by i)-1 as later from {{ev}}) select symbol, date, {r6('mom')} as score, {r6('later')} as later from w where later is not null")
both("add_11_heuristic_forecast", "Momentum blend of short and long windows less volatility, capped, with confidence, band and scenarios.", f"""
r as (select symbol, date, i, n, close, close/lag(close, 19) over (partition by symbol order by i)-1 as short_m, close/lag(close, 59) over (partition by symbol order by i)-1 as long_m, stddev_pop(ret) over (partition by symbol order by i rows between 38 preceding and current row) as vol, avg(ret) over (partition by symbol order by i rows between 38 preceding and current row) as drift,
  min(close) over (partition by symbol order by i rows between 14 preceding and current row) as support, max(close) over (partition by symbol order by i rows between 14 preceding and current row) as resistance from {{ix}}),
p as (select *, {clip("(short_m*0.38+long_m*0.28+drift*2.6-vol*0.52)*0.72*greatest(0.55, 1-vol*3.4)*100", "-3.2", "3.2")} as pct, {clip("0.38+(1-least(abs(short_m-long_m)*8, 0.42))*0.22+(1-least(vol*6, 0.38))*0.18+0.5*0.22", "0.34", "0.93")} as conf, {clip("vol*100*1.6", "0.6", "10.5")} as band from r where i=n-1 and long_m is not null)
select symbol, date, {r6('pct')} as return_pct, {r6('conf')} as confidence, {r6('band')} as band_pct, case when pct>greatest(0.55, vol*70) then 'bullish' when pct<-greatest(0.55, vol*70) then 'bearish' else 'sideways' end as trend, support, resistance,
  {r6('close*(1+(pct+greatest(greatest(band*0.55, 0.18), 0.08))/100)')} as bull, {r6('close*(1+(pct-greatest(greatest(band*0.7, 0.22), 0.08))/100)')} as bear from p""")
both("str_08_blended_return", "The older forecaster's blend: technical return, bias and sentiment scaled by the horizon, damped by volatility and capped by asset class.", f"""
r as (select symbol, date, i, mom, sd, case i%4 when 0 then 'equity' when 1 then 'commodity' when 2 then 'index' else 'crypto' end as asset, case i%3 when 0 then 1 when 1 then 5 else 20 end as days, ((i*7)%21-10)/1000.0 as bias from {{ev}}),
p as (select *, case when asset='commodity' and days<=2 then 1.4 when asset='index' and days<=2 then 1.8 when asset='crypto' then case when days<=5 then 6.5 else 12.0 end else case when days<=5 then 3.2 else 8.5 end end as cap from r)
select symbol, date, asset, days, {r6(clip("(mom*0.72+bias)*greatest(0.35, least(days/5.0, 3.8))*greatest(0.55, 1-sd*3.4)*100", "-cap", "cap"))} as return_pct from p""")

_PATH = """l as (select symbol, close, mom*100/4 as pct, greatest(0.25, sd*100*sqrt(5.0)) as band from {ev} where i=n-1), t as (select *, close*(1+pct/100) as target, close*band/100*0.18 as wave, case when pct>greatest(0.35, band*0.45) then 1 when pct<-greatest(0.35, band*0.45) then -1 else 0 end as sign from l)"""
both("mth_07_forecast_path", "An eased path to the forecast over eight steps with two sine waves, the first along the trend; the last step is the forecast.", _PATH + f""",
p as (select *, step/8.0 as frac from t cross join (values (1), (2), (3), (4), (5), (6), (7), (8)) as s(step))
select symbol, step, {r6("case when step=8 then target else greatest(1.0, close+(target-close)*(1-power(1-frac, 1.4))+sin(frac*pi()*1.5)*wave*sign+sin(frac*pi()*2.6)*wave*0.35) end")} as price from p""")
both("mth_08_scenarios", "Bull, base and bear returns around the forecast, apart by its uncertainty.", _PATH + f""" select symbol, scenario, {r6("pct+k*greatest(band*0.8, 0.25)")} as return_pct, {r6("close*(1+(pct+k*greatest(band*0.8, 0.25))/100)")} as target from t cross join (values ('bull', 1.0), ('base', 0.0), ('bear', -1.0)) as s(scenario, k)""")

# --- The sealed log -------------------------------------------------------
_LOG = """lg as (select symbol, date as as_of, i, fwd, sd, arm, case when arm='A' then case when mom>0 then 'up' else 'down' end else case when i%9=0 then 'flat' else 'up' end end as direction, least(0.95, 0.4+abs(mom)*2) as confidence, i%13=0 as degraded, cast(date as varchar(10)) || '|' || symbol || '|' || arm || '|5' as keyed from {ev} cross join (values ('A'), ('B')) as t(arm))"""
both("agg_21_forward_dashboard", "Predictions of each arm by direction, degraded ones and mean confidence.", _LOG + f" select arm, count(*) as n, count(case when direction='up' then 1 end) as up, count(case when direction='down' then 1 end) as down, count(case when direction='flat' then 1 end) as flat, count(case when degraded then 1 end) as degraded, {r6('avg(confidence)')} as confidence from lg group by arm")
both("agg_22_integrity", "Broken seals, repeated keys, outcomes not after their day, and whether all is well, by arm.", _LOG + """,
st as (select arm, keyed, as_of, direction, i, %SHA%(keyed || '|' || direction) as seal, case when i=100 and arm='A' then direction || '!' else direction end as held, as_of + case when i=200 and arm='B' then 0 else 7 end as scored from lg)
select arm, count(*) as predictions, count(case when %SHA%(keyed || '|' || held)<>seal then 1 end) as broken, count(*)-count(distinct keyed) as repeated, count(case when scored<=as_of then 1 end) as early, count(case when %SHA%(keyed || '|' || held)<>seal then 1 end)=0 and count(case when scored<=as_of then 1 end)=0 as ok from st group by arm""")
both("add_29_decision_hash", "A decision's content hash: all its fields in the order of their names.", _LOG + " select keyed, %SHA%('arm=' || arm || ';as_of=' || cast(as_of as varchar(10)) || ';confidence=' || cast(cast(floor(confidence*1000) as int) as varchar(5)) || ';direction=' || direction || ';symbol=' || symbol) as hash from lg")
both("srt_09_daily_shuffle", "The universe in an order that its day fixes.", "d as (select distinct symbol, date from {ev}) select date, symbol, cast(row_number() over (partition by date order by %SHA%(cast(date as varchar(10)) || symbol)) as bigint) as place from d")
both("stm_07_matured_outcomes", "Predictions whose horizon is over and that have no outcome yet are scored, each once.", _LOG + """, held as (select keyed from lg where i%3=0), ripe as (select keyed, as_of, direction, fwd from lg where fwd is not null)
select r.keyed, case when fwd>0.0005 then 'up' when fwd<-0.0005 then 'down' else 'flat' end as realised, direction=case when fwd>0.0005 then 'up' when fwd<-0.0005 then 'down' else 'flat' end as correct from ripe r left join held h on r.keyed=h.keyed where h.keyed is null""")
both("agg_39_search_stats", "Searches by phase and status, and the first and last day they found.", "s as (select source, case when doc_id%3=0 then 'reiteration' else 'from_scratch' end as phase, case when doc_id%5=0 then 'error' else 'success' end as status, (doc_id*5)%400 as age from {documents}) select source, count(*) as total, count(case when phase='from_scratch' then 1 end) as from_scratch, count(case when phase='reiteration' then 1 end) as reiterations, count(case when status='success' then 1 end) as successful, min(age) as newest_age, max(age) as oldest_age from s group by source")
both("agg_41_required_n", "Independent observations behind overlapping ones, and those that a difference needs at 80 % power.", f"""
s as (select symbol, count(*) as n, corr(ret, pr) as rho, sqrt(252.0)*avg(ret)/stddev_pop(ret) as sharpe from (select symbol, ret, lag(ret) over (partition by symbol order by date) as pr from {{ix}}) t where ret is not null and pr is not null group by symbol)
select symbol, n, {r6('n*(1-rho)/(1+rho)')} as effective_n, cast(ceil((2-2*rho+0.5*(sharpe*sharpe/252+power(sharpe+0.3, 2)/252-2*sharpe*(sharpe+0.3)/252*rho*rho))*power((1.959964+0.841621)/(0.3/sqrt(252.0)), 2)) as bigint) as required_n from s""")
both("add_08_table_statistics", "Wilson limits of accuracies, the standard error of a paired difference, its z and the steps that it needs.", f"""
p as (select symbol, count(*) as n, sum(case when sign(mom)=sign(fwd) then 1 else 0 end) as hits, sum(case when sign(fwd)>0 then 1 else 0 end) as ups, corr(case when sign(mom)=sign(fwd) then 1.0 else 0.0 end, case when fwd>0 then 1.0 else 0.0 end) as rho from {{ev}} where fwd is not null group by symbol),
q as (select *, hits*1.0/n as acc, (hits-ups)*1.0/n as diff, sqrt(2*0.25*(1-coalesce(rho, 0.0))/n) as se from p)
select symbol, n, {r6('acc')} as accuracy, {r6('(acc+1.9208/n)/(1+3.8416/n)-1.96*sqrt(acc*(1-acc)/n+0.9604/n/n)/(1+3.8416/n)')} as low, {r6('(acc+1.9208/n)/(1+3.8416/n)+1.96*sqrt(acc*(1-acc)/n+0.9604/n/n)/(1+3.8416/n)')} as high, {r6('se')} as paired_se, {r6('diff/se')} as z from q""")
both("agg_25_prediction_skill", "Skill at horizons of 1, 5 and 21 bars: accuracy with Wilson limits, information coefficients, symbols above one half, all bars and every h-th.", f"""
x as (select symbol, date, i, close/lag(close, 20) over (partition by symbol order by date)-1 as score, lead(close, 1) over (partition by symbol order by date)/close-1 as f1, lead(close, 5) over (partition by symbol order by date)/close-1 as f5, lead(close, 21) over (partition by symbol order by date)/close-1 as f21 from {{ix}}),
l as (select symbol, date, i, score, 1 as h, f1 as fwd from x union all select symbol, date, i, score, 5, f5 from x union all select symbol, date, i, score, 21, f21 from x),
s as (select *, 'all' as rows_used from l where score is not null and fwd is not null union all select *, 'apart' from l where score is not null and fwd is not null and i%h=0),
rk as (select *, rank() over (partition by h, rows_used order by score)+(count(*) over (partition by h, rows_used, score)-1)/2.0 as rs, rank() over (partition by h, rows_used order by fwd)+(count(*) over (partition by h, rows_used, fwd)-1)/2.0 as rf from s),
per as (select h, rows_used, symbol, avg(case when sign(score)=sign(fwd) then 1.0 else 0.0 end) as acc from s group by 1, 2, 3), beat as (select h, rows_used, sum(case when acc>0.5 then 1 else 0 end) as above from per group by 1, 2),
g as (select h, rows_used, count(*) as n, avg(case when sign(score)=sign(fwd) then 1.0 else 0.0 end) as acc, corr(score, fwd) as pearson, corr(rs, rf) as spearman from rk group by 1, 2)
select g.h, g.rows_used, n, {r6('acc')} as accuracy, {r6('(acc+1.9208/n)/(1+3.8416/n)-1.96*sqrt(acc*(1-acc)/n+0.9604/n/n)/(1+3.8416/n)')} as low, {r6('(acc+1.9208/n)/(1+3.8416/n)+1.96*sqrt(acc*(1-acc)/n+0.9604/n/n)/(1+3.8416/n)')} as high, {r6('spearman')} as spearman, {r6('pearson')} as pearson, {r6('(acc-0.5)/sqrt(0.25/n)')} as binomial_z, cast(above as bigint) as symbols_above from g join beat on g.h=beat.h and g.rows_used=beat.rows_used""")

# --- Memory of lessons ----------------------------------------------------
_SEEN = "sn as (select user_id, event_type as claim, case when user_id%4=0 then 'global' else event_type end as scope, cast(ts as date) as day from {events}), ls as (select user_id, claim, scope, count(*) as times_seen, min(day) as learned_on, max(day) as last_seen from sn group by 1, 2, 3)"
_CURATED = _SEEN + """,
st as (select *, @*least(4, greatest(1, times_seen)) as allowance from ls), a as (select *, %DAYS% as days from st),
rk as (select *, row_number() over (partition by days<=allowance order by times_seen desc, last_seen desc, user_id, claim) as place from a)
select user_id, claim, scope, times_seen, learned_on, last_seen, case when days>allowance then 'stale' when place>200 then 'over cap' else 'active' end as status from rk"""


def seen(spark, sf_dir):
    """user_id, claim, scope, times_seen, learned_on and last_seen of the lessons in the events."""
    scope = F.when(F.col("user_id") % 4 == 0, "global").otherwise(F.col("event_type"))
    x = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("claim"), scope.alias("scope"), F.to_date("ts").alias("day"))
    return x.groupBy("user_id", "claim", "scope").agg(F.count("*").alias("times_seen"), F.min("day").alias("learned_on"), F.max("day").alias("last_seen"))


_TODAY = "2024-02-20"


@query("stm_08_lessons", plain_sql(_CURATED.replace("@", "9")))
def stm_08_lessons(spark, sf_dir):
    """Lessons by status, with 9 stale days, as these tables hold one month."""
    return curated(seen(spark, sf_dir), ["user_id", "claim"], F.lit(_TODAY).cast("date"), stale_days=9)


@query("stm_08_lessons_90", plain_sql(_CURATED.replace("@", "90")))
def stm_08_lessons_90(spark, sf_dir):
    """Lessons by status with the usual 90 stale days."""
    return curated(seen(spark, sf_dir), ["user_id", "claim"], F.lit(_TODAY).cast("date"))


both("srt_06_recall", "Lessons learned before a day, most seen first and oldest first among equals.", _SEEN + " , o as (select *, row_number() over (partition by claim order by times_seen desc, learned_on, user_id) as place from ls where learned_on<date '2024-01-10') select claim, user_id, times_seen, learned_on, cast(place as bigint) as place from o where place<=10")
@query("srt_07_curator_cap", plain_sql(_SEEN + " , o as (select *, row_number() over (order by times_seen desc, last_seen desc, user_id, claim) as place from ls) select user_id, claim, times_seen, place<=200 as kept from o"))
def srt_07_curator_cap(spark, sf_dir):
    """The 200 lessons with most sightings stay, the newest of equals."""
    order = [F.desc("times_seen"), F.desc("last_seen"), F.col("user_id"), F.col("claim")]
    return with_cap(seen(spark, sf_dir), ["user_id", "claim"], order, 200).select("user_id", "claim", "times_seen", "kept")


both("add_27_memory_stats", "Lessons in all, in use and retired, and their scopes.", _SEEN + " select count(*) as total, count(case when last_seen>=date '2024-01-25' then 1 end) as active, count(case when last_seen<date '2024-01-25' then 1 end) as retired, count(distinct scope) as scopes from ls")

# --- Portfolios, watchlists, reports ---------------------------------------
both("join_09_call_history", "Reports beside the price of their symbol now, and whether the call was right.", f"""
rp as (select o_orderkey as report_id, p_brand as symbol, l_extendedprice/l_quantity/400 as then_price, case o_orderstatus when 'F' then 'buy' when 'O' then 'sell' else 'hold' end as call from {{orders}} join {{lineitem}} on o_orderkey=l_orderkey join {{part}} on l_partkey=p_partkey where l_linenumber=1),
m as (select rp.*, price/nullif(then_price, 0)-1 as move from rp left join {{quotes}} q on rp.symbol=q.symbol)
select report_id, symbol, call, {r6('move')} as move, case when move is null then 'pending' when call='buy' then case when move>0.01 then 'right' when move<-0.01 then 'wrong' else 'pending' end when call='sell' then case when move<-0.01 then 'right' when move>0.01 then 'wrong' else 'pending' end else case when abs(move)<=0.05 then 'right' else 'wrong' end end as verdict from m""")
both("srt_05_recent_trades", "The 50 newest trades of a user, newest first, within a ledger of 500.", "t as (select o_custkey as user_id, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as place from {orders}) select user_id, o_orderkey, cast(place as bigint) as place from t where place<=50")
both("set_01_concatenated", "Series of all symbols as one, with their own numbering kept.", f"select symbol, count(*) as bars, {r6('sum(ret)')} as total from (select symbol, i, ret from {{ix}} where i%2=0 union all select symbol, i, ret from {{ix}} where i%2=1) t group by symbol")
both("add_15_watchlist", "Additions are rejected if the list has the symbol in any case; profit in percent.", f"""
w as (select distinct o_custkey as user_id, upper(p_brand) as symbol from {{orders}} join {{lineitem}} on o_orderkey=l_orderkey join {{part}} on l_partkey=p_partkey where l_returnflag='A'), n as (select distinct o_custkey as user_id, lower(p_brand) as symbol, min(l_extendedprice/l_quantity/400) as cost from {{orders}} join {{lineitem}} on o_orderkey=l_orderkey join {{part}} on l_partkey=p_partkey where l_returnflag='R' group by 1, 2)
select n.user_id, n.symbol, w.symbol is not null as rejected, {r6('(q.price-n.cost)/n.cost*100')} as profit_pct from n left join w on n.user_id=w.user_id and upper(n.symbol)=w.symbol join {{quotes}} q on upper(q.symbol)=upper(n.symbol)""")
both("add_17_featured", "The first five featured symbols beside what the snapshot has of them.", "f as (select symbol, row_number() over (order by symbol desc) as place from (select distinct p_brand as symbol from {part}) t) select cast(place as bigint) as place, f.symbol, price, change_pct from f left join {quotes} q on f.symbol=q.symbol where place<=5")
both("stm_02_morning_digest", "On weekdays, once per market and day, each user's movers as one line.", """
w as (select distinct o_custkey as user_id, p_brand as symbol from {orders} join {lineitem} on o_orderkey=l_orderkey join {part} on l_partkey=p_partkey where l_returnflag='A'), q as (select symbol, k%3 as market, cast(floor(change_pct*100+0.5) as int) as cents from {quotes}),
j as (select user_id, market, w.symbol, cents from w join q on w.symbol=q.symbol) select user_id, market, count(*) as movers, min(symbol || case when cents>=0 then ' +' else ' ' end || cast(cents as varchar(9))) as first_mover, cast(sum(case when cents>=0 then 1 else 0 end) as bigint) as up from j group by user_id, market""")
both("snk_05_frozen_universe", "A universe is refused if the hash of its sorted symbols is not the one on record.", "u as (select grp, count(*) as symbols, %SHA%(%JOIN%) as hash from (select distinct p_type as grp, p_brand as symbol from {part}) t group by grp), r as (select grp, symbols, case when symbols%2=0 then hash else 'changed' end as recorded, hash from u) select grp, symbols, hash, hash<>recorded as refused from r")
both("snk_06_upsert", "The newest write of a key wins; with do-nothing the first stays.", "wr as (select o_custkey as k, o_orderkey as v, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as newest, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as oldest from {orders}) select k, max(case when newest=1 then v end) as do_update, max(case when oldest=1 then v end) as do_nothing from wr group by k")
both("src_13_ranked_sources", "Quotes of a country come from its best source; a cache counts only if it holds the country's own symbols.", """
s as (select p_brand as symbol, p_size%4 as country, p_size%3 as source_rank, p_retailprice as price, p_partkey from {part}), ok as (select country, source_rank from s group by 1, 2 having count(distinct symbol)>=20), b as (select country, min(source_rank) as best from ok group by country)
select s.country, s.source_rank, count(*) as rows, count(distinct symbol) as symbols from s join b on s.country=b.country and s.source_rank=b.best group by 1, 2""")
both("add_30_price_audit", "Of each price file: jumps over 15 percent, and closes away from adjusted ones by more than half a percent.", "a as (select symbol, ret, close, close*(1+case when i%50=0 then 0.01 else 0.001 end) as adj from {ix}) select symbol, count(*) as rows, count(case when abs(ret)>0.15 then 1 end) as jumps, count(case when abs(close-adj)/close>0.005 then 1 end) as adjusted from a group by symbol")
both("dec_12_requery_merge", "A second answer replaces the first unless it is unusable and the first is not.", "f as (select o_orderkey as task, o_totalprice>60000 as usable, 'first' as answer from {orders}), g as (select o_orderkey as task, o_custkey%3<>0 as usable, 'second' as answer from {orders} where o_orderkey%2=0) select coalesce(f.task, g.task) as task, case when g.task is null then f.answer when f.usable and not g.usable then f.answer else g.answer end as answer, g.task is not null and not (f.usable and not g.usable) as requeried from f full outer join g on f.task=g.task")
_TASKS = "p as (select distinct conv_id from conversations), tk as (select conv_id, unnest([1, 2, 3, 4, 5, 6, 7, 8]) as task from p), dp as (select conv_id, task, cast(floor(task/2) as int) as need from tk where task>1 union all select conv_id, task, cast(floor(task/3) as int) from tk where task>2)"


@query("join_12_waves", f"with recursive {_TASKS}, wv as (select conv_id, 1 as task, 0 as wave from p union all select dp.conv_id, dp.task, wv.wave+1 from wv join dp on wv.conv_id=dp.conv_id and wv.task=dp.need) select conv_id, task, max(wave) as wave from wv group by conv_id, task")
def join_12_waves(spark, sf_dir):
    """A task runs in the wave after the last of those that it needs: one join a wave, until no task is left."""
    plans = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    tasks = plans.select("conv_id", F.explode(F.array(*map(F.lit, range(1, 9)))).alias("task"))
    needs = tasks.select("conv_id", "task", F.explode(F.array_compact(F.array(*[F.when(F.col("task") > k - 1, F.floor(F.col("task") / k).cast("int")) for k in (2, 3)]))).alias("need"))
    return waves(tasks, needs, ["conv_id"]).select("conv_id", "task", "wave")


_SHIPMENTS = "x as (select l_partkey as part, year(l_shipdate) as yr, l_linenumber as task, l_quantity, lag(l_linenumber) over (partition by l_partkey, year(l_shipdate) order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) as need from lineitem)"


@query("join_12_shipment_waves", f"""with recursive {_SHIPMENTS}, nd as materialized (select distinct part, yr, task from x where l_quantity>=5), e as materialized (select distinct part, yr, task, need from x where need is not null and need<>task and l_quantity>=5),
p as (select nd.part, nd.yr, nd.task, 0 as depth, exists (select 1 from e left join nd m on m.part=e.part and m.yr=e.yr and m.task=e.need where m.task is null and e.part=nd.part and e.yr=nd.yr and e.task=nd.task) as bad from nd
  union select e.part, e.yr, e.task, p.depth+1, p.bad from p join e on e.part=p.part and e.yr=p.yr and e.need=p.task where p.depth<8)
select part, yr, task, case when max(depth)>=7 or bool_or(bad) then null else max(depth) end as wave, case when max(depth)>=7 or bool_or(bad) then 'error' else 'ok' end as status from p group by part, yr, task""")
def join_12_shipment_waves(spark, sf_dir):
    """Line numbers of a part's shipments in a year, each needing that of the shipment before; small shipments make no task, so needs may be missing, and cycles occur."""
    w = Window.partitionBy("l_partkey", F.year("l_shipdate")).orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    x = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.year("l_shipdate").alias("yr"), F.col("l_linenumber").alias("task"), "l_quantity", F.lag("l_linenumber").over(w).alias("need")).filter("l_quantity >= 5")
    return waves(x, x.filter("need <> task"), ["part", "yr"])


both("udt_01_scenario_rows", "Each symbol's newest bar makes a row for each scenario and horizon.", f"l as (select symbol, close, sd from {{ev}} where i=n-1) select symbol, scenario, h, {r6('close*(1+k*sd*sqrt(h*1.0))')} as target from l cross join (values ('bull', 1.0), ('base', 0.0), ('bear', -1.0)) as s(scenario, k) cross join (values (1), (5), (21)) as t(h)")
