"""Queries over quotes: screens, breadth, scorecards, comparisons, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numeric import clip, ratio, rounded
from tidemark.operators import screening as sc
from tidemark.plans.registry import query
from tidemark.plans.technical import r6
from tidemark.sources import market as m
from tidemark.sources.market import QUOTES_SQL

Q = f"with {QUOTES_SQL} "
_MOVE = "price, change_pct"


@query("src_12_quotes", Q + "select * from quotes")
def src_12_quotes(spark, sf_dir):
    return m.quotes(spark, sf_dir)


@query("flt_01_screener", Q + "select symbol, pe_ratio, beta, dividend_yield, market_cap from quotes where pe_ratio<=26 and dividend_yield>=2 and beta<=1.5 and market_cap>=1e9 and lower(symbol) like '%brand%'")
def flt_01_screener(spark, sf_dir):
    hits = sc.screen(m.quotes(spark, sf_dir), text="brand", pe_max=26, yield_min=2, beta_max=1.5, cap_min=1e9)
    return hits.select("symbol", "pe_ratio", "beta", "dividend_yield", "market_cap")


@query("flt_01_cross", Q + "select symbol, case when ma50>ma200 then 'golden' else 'death' end as trend_cross, case when change_pct>=0 then 'up' else 'down' end as direction from quotes where ma50 is not null and ma200 is not null")
def flt_01_cross(spark, sf_dir):
    q = m.quotes(spark, sf_dir)
    return sc.screen(q, cross="golden").withColumn("trend_cross", F.lit("golden")).unionByName(sc.screen(q, cross="death").withColumn("trend_cross", F.lit("death"))).select(
        "symbol", "trend_cross", F.when(F.col("change_pct") >= 0, "up").otherwise("down").alias("direction"))


_ASKS = ["pe under 20 and yield above 3%", "large cap low beta", "golden cross stocks going up", "death cross", "p/e below 30", "high dividend"]


@query(
    "flt_02_natural_language",
    "with asks as (select unnest(["
    + ", ".join(f"'{a}'" for a in _ASKS)
    + "]) as ask) select ask, try_cast(nullif(regexp_extract(ask, '(?:p/e|pe) (?:under|below) ([0-9.]+)', 1), '') as double) as pe_max, case when regexp_matches(ask, 'yield (?:above|over) [0-9.]+') then cast(regexp_extract(ask, 'yield (?:above|over) ([0-9.]+)', 1) as double) when ask like '%high dividend%' then 3.0 end as yield_min, case when ask like '%large cap%' then 1e10 end as cap_min, case when ask like '%low beta%' then 1.0 end as beta_max, case when ask like '%golden cross%' then 'golden' when ask like '%death cross%' then 'death' end as crossed, case when regexp_matches(ask, 'going up|gainers') then 'up' when regexp_matches(ask, 'going down|losers') then 'down' end as direction from asks",
)
def flt_02_natural_language(spark, sf_dir):
    return sc.parse_requests(spark.createDataFrame([(a,) for a in _ASKS], "ask string"))


@query("flt_02_request_hits", Q + ", asks as (select unnest(['pe under 20', 'pe below 30']) as ask), p as (select ask, cast(regexp_extract(ask, '([0-9.]+)', 1) as double) as pe_max from asks) select ask, count(*) as hits, min(symbol) as first from p join quotes on pe_ratio<=pe_max group by ask")
def flt_02_request_hits(spark, sf_dir):
    """Parsed requests joined to the quotes they select; the requests are the small side."""
    asks = sc.parse_requests(spark.createDataFrame([("pe under 20",), ("pe below 30",)], "ask string"))
    hits = m.quotes(spark, sf_dir).join(F.broadcast(asks), F.col("pe_ratio") <= F.col("pe_max"))
    return hits.groupBy("ask").agg(F.count("*").alias("hits"), F.min("symbol").alias("first"))


@query("flt_03_gainers_losers", Q + "select symbol, case when change_pct>0 then 'gainer' else 'loser' end as tab, change_pct from quotes where change_pct<>0 and upper(symbol) like '%BRAND#2%'")
def flt_03_gainers_losers(spark, sf_dir):
    return m.quotes(spark, sf_dir).filter((F.col("change_pct") != 0) & F.upper("symbol").contains("BRAND#2")).select("symbol", F.when(F.col("change_pct") > 0, "gainer").otherwise("loser").alias("tab"), "change_pct")


@query("flt_06_dividends", Q + "select symbol, dividend_yield from quotes where dividend_yield>0 order by dividend_yield desc, symbol limit 30")
def flt_06_dividends(spark, sf_dir):
    return m.quotes(spark, sf_dir).filter("dividend_yield > 0").orderBy(F.desc("dividend_yield"), "symbol").limit(30).select("symbol", "dividend_yield")


@query("agg_11_sector_heatmap", Q + f"select sector, count(*) as n, {r6('avg(change_pct)')} as avg_change, arg_max(symbol, (change_pct, symbol)) as top_gainer, arg_min(symbol, (change_pct, symbol)) as top_loser from quotes group by sector")
def agg_11_sector_heatmap(spark, sf_dir):
    order = F.struct("change_pct", "symbol")
    return m.quotes(spark, sf_dir).groupBy("sector").agg(F.count("*").alias("n"), rounded(F.avg("change_pct")).alias("avg_change"), F.max_by("symbol", order).alias("top_gainer"), F.min_by("symbol", order).alias("top_loser"))


_BREADTH = Q + ", b as (select count(*) as total, count(*) filter (change_pct>0) as advancing, avg(change_pct) as mv, avg(least(greatest((price-lo52)/nullif(hi52-lo52,0),0),1)) filter (hi52>lo52) as pos, count(*) filter (hi52>lo52) as ranged from quotes), s as (select *, advancing*100.0/total as br from b)"


@query("agg_12_breadth_regime", _BREADTH + f" select total, advancing, {r6('br')} as breadth_pct, {r6('mv')} as avg_move, {r6('(br-50)/50+mv/2')} as score, case when (br-50)/50+mv/2>0.25 then 'risk-on' when (br-50)/50+mv/2<-0.25 then 'risk-off' else 'neutral' end as regime from s")
def agg_12_breadth_regime(spark, sf_dir):
    return sc.breadth(m.quotes(spark, sf_dir)).select("total", "advancing", rounded(F.col("breadth")).alias("breadth_pct"), rounded(F.col("move")).alias("avg_move"), rounded(F.col("score")).alias("score"), "regime")


@query("agg_13_fear_greed", _BREADTH + ", g as (select floor(least(greatest(br*0.5+least(greatest(50+mv*12,0),100)*0.3+(case when ranged>=3 then pos*100 else 50 end)*0.2,0),100)+0.5) as idx from s) select cast(idx as bigint) as fear_greed, case when idx<25 then 'Extreme Fear' when idx<45 then 'Fear' when idx<=55 then 'Neutral' when idx<=75 then 'Greed' else 'Extreme Greed' end as label from g")
def agg_13_fear_greed(spark, sf_dir):
    return sc.breadth(m.quotes(spark, sf_dir)).select("fear_greed", "label")


@query("srt_01_nulls_last", Q + "select symbol, pe_ratio, row_number() over (order by pe_ratio asc nulls last, symbol) as up_rank, row_number() over (order by pe_ratio desc nulls last, symbol) as down_rank from quotes")
def srt_01_nulls_last(spark, sf_dir):
    """Ranks of the quotes, one row a symbol."""
    w = Window.partitionBy(F.lit(0))
    return m.quotes(spark, sf_dir).select("symbol", "pe_ratio", F.row_number().over(w.orderBy(F.asc_nulls_last("pe_ratio"), "symbol")).alias("up_rank"), F.row_number().over(w.orderBy(F.desc_nulls_last("pe_ratio"), "symbol")).alias("down_rank"))


@query("srt_02_null_as_zero", Q + "select symbol, coalesce(pe_ratio,0) as pe from quotes order by 2 desc, 1 limit 12")
def srt_02_null_as_zero(spark, sf_dir):
    return m.quotes(spark, sf_dir).select("symbol", F.coalesce("pe_ratio", F.lit(0.0)).alias("pe")).orderBy(F.desc("pe"), "symbol").limit(12)


@query("srt_03_leaders_laggards", Q + "select * from (select 'leader' as side, symbol, change_pct from quotes order by change_pct desc, symbol limit 3) union all select * from (select 'laggard', symbol, change_pct from quotes order by change_pct, symbol limit 3) union all select * from (select 'volume', symbol, volume from quotes order by volume desc, symbol limit 6)")
def srt_03_leaders_laggards(spark, sf_dir):
    q = m.quotes(spark, sf_dir)
    parts = [(F.desc("change_pct"), "leader", "change_pct", 3), (F.asc("change_pct"), "laggard", "change_pct", 3), (F.desc("volume"), "volume", "volume", 6)]
    tops = [q.orderBy(o, "symbol").limit(n).select(F.lit(side).alias("side"), "symbol", F.col(c).alias("change_pct")) for o, side, c, n in parts]
    return tops[0].unionByName(tops[1]).unionByName(tops[2])


@query("srt_10_dividend_sort", Q + "select symbol, dividend_yield, change_pct from quotes where dividend_yield>0 order by change_pct desc, symbol limit 8")
def srt_10_dividend_sort(spark, sf_dir):
    return m.quotes(spark, sf_dir).filter("dividend_yield > 0").select("symbol", "dividend_yield", "change_pct").orderBy(F.desc("change_pct"), "symbol").limit(8)


# Fixed values of the score ladders: (upper bound, score), and the score above all bounds.
VALUATION = ([(10, 92), (15, 84), (20, 74), (25, 64), (35, 50), (50, 36)], 22)
STABILITY = ([(0.7, 90), (1.0, 76), (1.3, 60), (1.7, 44)], 30)
_VAL = "case when pe_ratio is null then null when pe_ratio<=0 then 28 " + " ".join(f"when pe_ratio<{b} then {s}" for b, s in VALUATION[0]) + f" else {VALUATION[1]} end"
_STAB = "case when beta is null then null " + " ".join(f"when beta<{b} then {s}" for b, s in STABILITY[0]) + f" else {STABILITY[1]} end"
_INC = "case when dividend_yield is null then null when dividend_yield>=4 then 95 when dividend_yield>=2.5 then 80 when dividend_yield>=1 then 60 when dividend_yield>0 then 42 else 20 end"
_MOMS = "50+case when ma50 is null then 0 when price>=ma50 then 14 else -12 end+case when ma200 is null then 0 when price>=ma200 then 14 else -12 end+case when ma50 is null or ma200 is null then 0 when ma50>=ma200 then 8 else -8 end+case when hi52>lo52 then case when (price-lo52)/(hi52-lo52)*100 between 40 and 88 then 8 when (price-lo52)/(hi52-lo52)*100>88 then 3 when (price-lo52)/(hi52-lo52)*100<20 then -8 else 0 end else 0 end"
_CARD = Q + f", dims as (select symbol, sector, {_VAL} as val, {_MOMS} as mom, {_STAB} as stab, {_INC} as inc from quotes), card as (select *, floor((coalesce(val*0.3,0)+coalesce(mom*0.3,0)+coalesce(stab*0.2,0)+coalesce(inc*0.2,0))/nullif((case when val is null then 0 else 0.3 end+case when mom is null then 0 else 0.3 end+case when stab is null then 0 else 0.2 end+case when inc is null then 0 else 0.2 end),0)+0.5) as overall, (val is not null)::int+(mom is not null)::int+(stab is not null)::int+(inc is not null)::int as present from dims)"


@query("mth_09_scorecard", _CARD + " select symbol, val, mom, stab, inc, cast(overall as bigint) as overall, case when overall>=75 then 'Strong' when overall>=60 then 'Good' when overall>=45 then 'Average' else 'Weak' end as band from card where present>=2")
def mth_09_scorecard(spark, sf_dir):
    return sc.scorecard(m.quotes(spark, sf_dir), VALUATION, STABILITY).select("symbol", "val", "mom", "stab", "inc", "overall", "band")


@query("mth_10_compare_verdict", _CARD + ", r as (select *, row_number() over (partition by sector order by overall desc, symbol) as rk from card where present>=2) select a.sector, a.symbol as winner, b.symbol as runner, cast(a.overall-b.overall as bigint) as margin, a.overall-b.overall<=3 as tie from r a join r b on a.sector=b.sector and a.rk=1 and b.rk=2")
def mth_10_compare_verdict(spark, sf_dir):
    card = sc.scorecard(m.quotes(spark, sf_dir), VALUATION, STABILITY)
    r = card.withColumn("rk", F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("overall"), "symbol"))).filter("rk <= 2")
    two = r.groupBy("sector").agg(F.max_by("symbol", -F.col("rk")).alias("winner"), F.max_by("symbol", F.col("rk")).alias("runner"), (F.max_by("overall", -F.col("rk")) - F.max_by("overall", F.col("rk"))).alias("margin"), F.count("*").alias("c"))
    return two.filter("c = 2").select("sector", "winner", "runner", "margin", (F.col("margin") <= 3).alias("tie"))


@query("mth_11_best_in_row", Q + ", u as (unpivot (select symbol, change_pct, dividend_yield, beta from quotes) on change_pct, dividend_yield, beta into name metric value v) select metric, max(v) as best, arg_max(symbol, (v, symbol)) as symbol from u group by metric")
def mth_11_best_in_row(spark, sf_dir):
    u = m.quotes(spark, sf_dir).unpivot("symbol", ["change_pct", "dividend_yield", "beta"], "metric", "v").filter("v is not null")
    return u.groupBy("metric").agg(F.max("v").alias("best"), F.max_by("symbol", F.struct("v", "symbol")).alias("symbol"))


@query("mth_13_labels", Q + "select symbol, case when pe_ratio is null then 'n/a' when pe_ratio<15 then 'cheap' when pe_ratio<25 then 'fair' else 'rich' end as valuation, case when beta is null then 'n/a' when beta<0.8 then 'defensive' when beta<=1.2 then 'market' else 'aggressive' end as risk, case when change_pct>1 then 'strong' when change_pct<-1 then 'weak' else 'steady' end as momentum from quotes")
def mth_13_labels(spark, sf_dir):
    pe, beta, move = F.col("pe_ratio"), F.col("beta"), F.col("change_pct")
    return m.quotes(spark, sf_dir).select(
        "symbol", F.when(pe.isNull(), "n/a").when(pe < 15, "cheap").when(pe < 25, "fair").otherwise("rich").alias("valuation"),
        F.when(beta.isNull(), "n/a").when(beta < 0.8, "defensive").when(beta <= 1.2, "market").otherwise("aggressive").alias("risk"),
        F.when(move > 1, "strong").when(move < -1, "weak").otherwise("steady").alias("momentum"),
    )


@query("mth_16_heat", Q + f"select symbol, {r6('least(greatest(change_pct,-3.0),3.0)/3')} as heat from quotes")
def mth_16_heat(spark, sf_dir):
    return m.quotes(spark, sf_dir).select("symbol", rounded(clip(F.col("change_pct"), -3, 3) / 3).alias("heat"))


@query("win_42_range_position", Q + f"select symbol, case when hi52>lo52 then {r6('least(greatest((price-lo52)/(hi52-lo52)*100,0.0),100.0)')} end as position_pct from quotes")
def win_42_range_position(spark, sf_dir):
    return m.quotes(spark, sf_dir).select("symbol", rounded(clip(ratio((F.col("price") - F.col("lo52")) * 1.0, F.col("hi52") - F.col("lo52")) * 100, 0, 100)).alias("position_pct"))


@query("src_14_gap_fill", Q + ", sec as (select sector, avg(pe_ratio) as spe from quotes group by sector) select symbol, coalesce(pe_ratio, " + r6("spe") + ", 0) as pe_filled, pe_ratio is null as filled from quotes left join sec using (sector)")
def src_14_gap_fill(spark, sf_dir):
    """Only missing values are taken from the fallback source."""
    q = m.quotes(spark, sf_dir)
    sec = q.groupBy("sector").agg(rounded(F.avg("pe_ratio")).alias("spe"))
    return q.join(sec, "sector", "left").select("symbol", F.coalesce("pe_ratio", "spe", F.lit(0.0)).alias("pe_filled"), F.col("pe_ratio").isNull().alias("filled"))


@query("src_19_symbol_dialects", Q + "select symbol, replace(symbol, '#', '.') || case when k%3=0 then '.L' when k%3=1 then '' else '.DE' end as vendor_symbol, case when k%3=0 then 'GB' when k%3=1 then 'US' else 'DE' end as country, case when k%3=0 then 'GBP' when k%3=1 then 'USD' else 'EUR' end as currency from quotes")
def src_19_symbol_dialects(spark, sf_dir):
    q = m.quotes(spark, sf_dir).withColumn("vendor_symbol", F.concat(F.translate("symbol", "#", "."), F.when(F.col("k") % 3 == 0, ".L").when(F.col("k") % 3 == 1, "").otherwise(".DE")))
    suffix = F.regexp_extract("vendor_symbol", r"\.(L|DE)$", 1)
    return q.select("symbol", "vendor_symbol", F.when(suffix == "L", "GB").when(suffix == "DE", "DE").otherwise("US").alias("country"), F.when(suffix == "L", "GBP").when(suffix == "DE", "EUR").otherwise("USD").alias("currency"))


@query("str_13_formats", Q + "select symbol, case when market_cap>=1e12 then printf('%.2fT', floor(market_cap/1e12*100+0.5)/100) when market_cap>=1e9 then printf('%.2fB', floor(market_cap/1e9*100+0.5)/100) else printf('%.2fM', floor(market_cap/1e6*100+0.5)/100) end as cap, printf('%+.2f%%', floor(change_pct*100+0.5)/100) as change from quotes")
def str_13_formats(spark, sf_dir):
    cap = F.col("market_cap")
    shown = [F.format_string(f"%.2f{u}", rounded(cap / s, 2)) for u, s in (("T", 1e12), ("B", 1e9), ("M", 1e6))]
    return m.quotes(spark, sf_dir).select("symbol", F.when(cap >= 1e12, shown[0]).when(cap >= 1e9, shown[1]).otherwise(shown[2]).alias("cap"), F.format_string("%+.2f%%", rounded(F.col("change_pct"), 2)).alias("change"))


@query("add_19_polyline", Q + ", p as (select symbol, sector, price, max(price) over (partition by sector) as hi, min(price) over (partition by sector) as lo from quotes) select symbol, " + r6("(price-lo)/greatest(hi-lo,1.0)") + " as y from p")
def add_19_polyline(spark, sf_dir):
    w = Window.partitionBy("sector")
    low, high = F.min("price").over(w), F.max("price").over(w)
    return m.quotes(spark, sf_dir).select("symbol", rounded((F.col("price") - low) / F.greatest(high - low, F.lit(1.0))).alias("y"))


@query("mth_05_vol_regime", Q + "select symbol, case when beta is null then 'unknown' when beta*20<20 then 'low_vol' when beta*20<40 then 'mid_vol' else 'high_vol' end as regime from quotes")
def mth_05_vol_regime(spark, sf_dir):
    vol = F.col("beta") * 20
    return m.quotes(spark, sf_dir).select("symbol", F.when(vol.isNull(), "unknown").when(vol < 20, "low_vol").when(vol < 40, "mid_vol").otherwise("high_vol").alias("regime"))
