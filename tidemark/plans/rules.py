"""Row-wise rules over questions, news, quotes and forecasts: planners, profiles, labels, text ladders.

A rule is a set of expressions that Spark and DuckDB read alike; each query names the
table it runs over and the columns it adds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.lexicon import ASSET_TERMS, BIAS, EXPENSE, FLAGS, GOALS, HORIZONS, INCOME, MACRO, NAMES, QUALITY
from tidemark.plans.registry import query
from tidemark.plans.technical import r6
from tidemark.sources.market import QUOTES_SQL, quotes, table

#: What users ask in these tables: one of these phrases before the invented prose of a turn.
PHRASES = (
    "Should I buy apple over 3 weeks", "gold outlook this month with inflation", "What is a dividend", "oil today after tariffs and opec", "sell my TSLA shares next week",
    "bitcoin etf adoption tomorrow", "nasdaq risk-off in a recession", "NVDA earnings guidance in 2 months", "is MSFT safe for 1 year", "technical trend and momentum of $AMD", "news on meta", "chart",
)
ASKS = "asks as (select conv_id, turn, [" + ", ".join(f"'{p}'" for p in PHRASES) + f"][cast((conv_id+turn)%{len(PHRASES)} as int)+1] as q, (conv_id*7+turn)%100/100.0 as mood from conversations), ask as (select conv_id, turn, q, lower(q) as low, cast(mood as double) as mood from asks)"


def asks(spark, sf_dir):
    """conv_id, turn, q (the question), low (in lower case) and mood (sentiment of the news on it, 0 to 1)."""
    x = table(spark, sf_dir, "conversations")
    q = F.element_at(F.array(*map(F.lit, PHRASES)), ((F.col("conv_id") + F.col("turn")) % len(PHRASES) + 1).cast("int"))
    return x.select("conv_id", "turn", q.alias("q"), F.lower(q).alias("low"), ((F.col("conv_id") * 7 + F.col("turn")) % 100 / 100.0).alias("mood"))


NEWS = "news as (select doc_id, source, lang, n_chars, doc_id%97/100.0 as relevance, (doc_id*5)%400 as age, case doc_id%5 when 0 then 'STRONG_BUY' when 1 then 'BUY' when 2 then 'HOLD' when 3 then 'SELL' else 'STRONG_SELL' end as level, (doc_id%11)/10.0 as conf, case doc_id%9 when 0 then 'Reuters' when 1 then 'Bloomberg News' when 2 then 'CNBC' when 3 then 'MarketWatch' when 4 then 'NewsAPI' when 5 then 'The Wall Street Journal' when 6 then 'Synthetic research feed' when 7 then 'Financial Times' else source end as outlet from documents)"


def news(spark, sf_dir):
    """Articles with an outlet, a relevance, an age in hours, a five-step label and its confidence."""
    outlet = "case doc_id%9 when 0 then 'Reuters' when 1 then 'Bloomberg News' when 2 then 'CNBC' when 3 then 'MarketWatch' when 4 then 'NewsAPI' when 5 then 'The Wall Street Journal' when 6 then 'Synthetic research feed' when 7 then 'Financial Times' else source end as outlet"
    level = "case doc_id%5 when 0 then 'STRONG_BUY' when 1 then 'BUY' when 2 then 'HOLD' when 3 then 'SELL' else 'STRONG_SELL' end as level"
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "lang", "n_chars", "doc_id%97/100.0D as relevance", "(doc_id*5)%400 as age", level, "(doc_id%11)/10.0D as conf", outlet)


BRIEFS = f"{QUOTES_SQL}, brief as (select symbol, k, change_pct as ret, coalesce(pe_ratio, 18.0) as pe, beta, ((k*13)%100)/100.0 as conf, ((k*7)%60)/10.0 as band, ((k*11)%41-20)/10.0 as score, case k%3 when 0 then 'low' when 1 then 'medium' else 'high' end as risk, case when change_pct>0.3 then 'bullish' when change_pct<-0.3 then 'bearish' else 'sideways' end as trend, case k%5 when 0 then 'BUY' when 1 then 'STRONG_BUY' when 2 then 'SELL' when 3 then 'STRONG_SELL' else 'HOLD' end as level, case k%5 when 0 then 'today' when 1 then 'next 1-2 sessions' when 2 then '5 trading days' when 3 then '1 trading month' else 'short-term' end as label, k%6=0 as estimated, case k%3 when 0 then 'high' when 1 then 'low' else 'medium' end as profile from quotes)"


def briefs(spark, sf_dir):
    """Forecast, risk and sentiment of each symbol as a report holds them."""
    return quotes(spark, sf_dir).selectExpr(
        "symbol", "k", "change_pct as ret", "coalesce(pe_ratio, 18.0D) as pe", "beta", "((k*13)%100)/100.0D as conf", "((k*7)%60)/10.0D as band", "((k*11)%41-20)/10.0D as score", "case k%3 when 0 then 'low' when 1 then 'medium' else 'high' end as risk",
        "case when change_pct>0.3 then 'bullish' when change_pct<-0.3 then 'bearish' else 'sideways' end as trend", "case k%5 when 0 then 'BUY' when 1 then 'STRONG_BUY' when 2 then 'SELL' when 3 then 'STRONG_SELL' else 'HOLD' end as level",
        "case k%5 when 0 then 'today' when 1 then 'next 1-2 sessions' when 2 then '5 trading days' when 3 then '1 trading month' else 'short-term' end as label", "k%6=0 as estimated", "case k%3 when 0 then 'high' when 1 then 'low' else 'medium' end as profile")


#: Name, table expression, Spark table and key columns of what rules run over.
OVER = {"ask": (ASKS, asks, ("conv_id", "turn")), "news": (NEWS, news, ("doc_id",)), "brief": (BRIEFS, briefs, ("symbol",))}


def rule(name: str, over: str, columns: dict[str, str], doc: str) -> None:
    """Register ``columns`` (name to expression) over a table; a column may use those before it."""
    head, source, keys = OVER[over]
    steps, last = [], over
    for k, (column, expression) in enumerate(columns.items()):
        steps.append(f"s{k} as (select *, {expression} as {column} from {last})")
        last = f"s{k}"

    def run(spark, sf_dir):
        x = source(spark, sf_dir)
        for column, expression in columns.items():
            x = x.withColumn(column, F.expr(expression))
        return x.select(*keys, *[c for c in columns if not c.startswith("_")])

    run.__name__, run.__doc__ = name, doc
    query(name, f"with {head}, {', '.join(steps)} select {', '.join([*keys, *[c for c in columns if not c.startswith('_')]])} from {last}")(run)


def has(terms, text: str = "low") -> str:
    return "(" + " or ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def ladder(cases, default: str) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in cases) + f" else {default} end"


def text(value: str) -> str:
    return f"'{value}'"


def double(value: str) -> str:
    return f"cast({value} as double)"


_HORIZON = {f"_{f}": ladder([(has(terms), str(v) if f == "days" else text(label)) for terms, v, label in HORIZONS], "5" if f == "days" else "'5 trading days'") for f in ("days", "label")}
_ASSET = ladder([(has(terms), text(asset)) for asset, terms in ASSET_TERMS], "'equity'")
_BIAS = "case asset " + " ".join(f"when '{a}' then " + "+".join(double(f"case when {has(FLAGS[f])} then {w} else 0 end") for f, w in weights.items() if f in FLAGS) for a, weights in BIAS.items()) + " end"
_PROFILE = {"horizon_days": _HORIZON["_days"], "horizon": _HORIZON["_label"], "asset": _ASSET, "_bias": _BIAS, "bias": r6("_bias")}

rule("str_06_query_flags", "ask", {f"f_{f}": has(terms) for f, terms in FLAGS.items()}, "Which of the 22 flags a question raises.")
rule("str_07_context_profile", "ask", _PROFILE | {"alignment": r6(f"least({double('0.98')}, {double('0.42')}+abs(_bias)*0.8+0.08+abs(mood-0.5)*0.5)")}, "Horizon, asset class, bias of the flags raised, and alignment.")

_ADJUST = double("case when asset='oil' and " + has(FLAGS["tariff"]) + " and horizon_days<=2 then -0.18 when asset='gold' and " + has(FLAGS["safe_haven"]) + " then 0.08 else 0 end")
_CAPS = {"equity": (3.5, 6.5, 12.0), "gold": (1.8, 3.8, 7.0), "oil": (2.2, 5.5, 10.0), "crypto": (6.0, 12.0, 20.0), "index": (2.4, 4.8, 8.8)}
_CAP = "case asset " + " ".join(f"when '{a}' then case when horizon_days<=2 then {s} when horizon_days<=7 then {m} else {g} end" for a, (s, m, g) in _CAPS.items()) + " end"
rule(
    "mth_06_adjusted_return", "ask",
    _PROFILE | {"_adjust": f"_bias+{_ADJUST}+(mood-0.5)*{double(chr(39) + '1.1' + chr(39))}", "_raw": "_adjust+(mood-0.3)*20", "_cap": double(_CAP), "return_pct": r6("greatest(-_cap, least(_cap, _raw))"), "trend": "case when return_pct>greatest(0.35, 1.2*0.45) then 'bullish' when return_pct<-greatest(0.35, 1.2*0.45) then 'bearish' else 'sideways' end",
     "confidence": r6(f"least(0.9, greatest(0.28, ({double('0.22')}+0.54*0.4+greatest(0.0, 1-1.1/greatest(1.2*1.5, 0.5))*0.23+least(abs(return_pct)/1.2, 1.0)*0.15)*0.72))")},
    "Question and sentiment move a raw return, which is capped by asset and horizon and labelled.",
)

_UNIT = "regexp_extract(low, '([0-9]+) *(day|week|wk|month|mo|year|yr)s?', 2)"
_AMOUNT = "regexp_extract(low, '([0-9]+) *(day|week|wk|month|mo|year|yr)s?', 1)"
_DAYS = f"case when {_AMOUNT}='' then {{default}} else cast({_AMOUNT} as int)*case when {_UNIT}='day' then 1 when {_UNIT} in ('week', 'wk') then 7 when {_UNIT} in ('month', 'mo') then 30 else 365 end end"
rule("str_11_planner", "ask", {
    "horizon_days": _DAYS.format(default=90), "goal": ladder([(has(terms), text(goal)) for goal, terms in GOALS], "'investment'"), "risk": "case (conv_id+turn)%3 when 0 then 'low' when 1 then 'medium' else 'high' end",
    "objective": "case risk when 'low' then 'capital_preservation' when 'medium' then 'balanced' else 'growth' end", "on_risk": has(("risk", "safe", "volatil", "downside", "drawdown", "var")) + " or goal='exit'",
    "on_news": has(("news", "sentiment", "headline", "announc", "earnings")), "on_market": has(("price", "chart", "technical", "trend", "momentum"))}, "First planner: horizon, goal, objective and emphasis.")

_SYMBOL = "regexp_extract(q, '(^|[^A-Za-z])([A-Z]{2,5})([^A-Za-z]|$)', 2)"
_NAMED = ladder([(f"contains(low, '{n}')", text(s)) for n, s in NAMES.items()], "''")
rule("str_10_plan_intent", "ask", {
    "intent": "case when contains(low, 'should i') or contains(low, 'my position') or contains(low, 'my shares') or contains(low, 'my stake') or contains(low, 'my tsla shares') or contains(low, 'buy') or contains(low, 'sell') then 'advice' else 'assess' end",
    "horizon_days": _DAYS.format(default=5), "_symbol": _SYMBOL, "_stop": "_symbol in ('THE', 'IS', 'IT', 'MY', 'AND', 'OR', 'TO', 'IN', 'ON', 'AT', 'BE', 'DO', 'IF', 'SO', 'UP', 'AM', 'PE', 'US', 'CEO', 'ETF', 'AI')",
    "ticker": f"case when _symbol<>'' and not _stop then _symbol else {_NAMED} end", "posture": "case when (conv_id+turn)%4=3 then 'medium' else case (conv_id+turn)%3 when 0 then 'low' when 1 then 'medium' else 'high' end end"}, "Planner without a model: intent, horizon, ticker and posture.")
rule("str_09_ticker_inference", "ask", {
    "_dollar": "regexp_extract(upper(q), '[$]([A-Z][A-Z0-9.-]*)', 1)", "_word": "regexp_extract(upper(q), '([A-Z][A-Z0-9.-]*)', 1)", "_named": _NAMED,
    "ticker": "case when _dollar<>'' then _dollar when _named<>'' then _named when _word in ('SHOULD', 'WHAT', 'IS', 'THE') then '' else _word end"}, "A $symbol, else a known company, else the first word that is no stop word.")
rule("dec_13_default_agents", "ask", {
    "intent": "case when contains(low, 'what is') then 'define' when contains(low, 'should i') or contains(low, 'sell') then 'advice' when contains(low, 'safe') then 'risk_check' when contains(low, 'news') then 'summarize' when contains(low, 'trend') then 'trend' else 'assess' end",
    "agents": "case intent when 'define' then '' when 'advice' then 'market,analyst,risk,researcher' when 'risk_check' then 'risk,market,analyst' when 'summarize' then 'researcher,fundamentals' when 'trend' then 'market,fundamentals' else 'market,analyst,researcher,fundamentals' end",
    "at_risk": "intent in ('advice', 'risk_check')"}, "Agents by intent; a definition needs none, and capital at risk always a risk estimate.")
rule("add_28_plan_prior", "ask", {
    "planned": "case when (conv_id+turn)%3=0 then '' else 'market' end", "_prior": "case when contains(low, 'what is') then '' when contains(low, 'sell') then 'market,analyst,risk,researcher' else 'market,analyst,researcher,fundamentals' end",
    "subtasks": "case when planned='' then _prior else planned end", "added_risk": "contains(low, 'sell') and not contains(subtasks, 'risk')"}, "A plan without subtasks takes the routing prior; capital at risk adds the risk agent.")
rule("add_13_search_queries", "ask", {
    "_macro": has(MACRO), "queries": "case when _macro then 2 else 3 end", "first": "'ACME ' || q", "second": "case when _macro then 'ACME macro impact market reaction' else 'ACME price forecast outlook investor' end",
    "third": "case when _macro then null else 'ACME earnings financial performance guidance' end"}, "Two searches for a macro question, three for others.")
rule("str_12_ledger_type", "ask", {"note": "case (conv_id+turn)%7 when 0 then 'Rent received flat 2' when 1 then 'rent and bills' when 2 then 'Salary June' when 3 then 'petrol' when 4 then 'gift' when 5 then 'Stock sale profit' else low end", "kind": ladder([(has(INCOME, "lower(note)"), "'income'"), (has(EXPENSE, "lower(note)"), "'expense'")], "null")}, "Income words come first, so rent received is income.")
rule("add_18_mood", "ask", {
    "_day": "mood*6-3", "_month": "mood*20-10", "mood_text": "case when _day>=1.2 then 'strongly positive' when _day<=-1.2 then 'cautious' when _month>=6 then 'constructive' when _month<=-6 then 'fragile' else 'steady' end",
    "symbol": "case when regexp_extract(upper(q), '[$]([A-Z][A-Z0-9.-]*)', 1)<>'' then regexp_extract(upper(q), '[$]([A-Z][A-Z0-9.-]*)', 1) else regexp_extract(upper(q), '([A-Z][A-Z0-9.-]*)', 1) end"}, "Market mood by the day's and month's move, and the first symbol-like word.")
rule("dec_14_default_params", "ask", {
    "_own": "case when (conv_id+turn)%4=0 then 10 else null end", "horizon_days": "coalesce(_own, 5)", "risk_posture": "case when (conv_id+turn)%5=0 then 'high' else 'medium' end", "_named": _NAMED,
    "ticker": "case when _named<>'' then _named else 'SPY' end", "query": "ticker"}, "Subtask parameters keep their own values and take the plan's where they have none.")
rule("dat_06_horizon_context", "ask", {
    "label": ladder([(has(t), text(n)) for t, _, n in HORIZONS], "'short-term'"), **{c: double("case label when 'today' then {} when 'next 1-2 sessions' then {} when '1 trading week' then {} when '1 trading month' then {} else {} end".format(*v)) for c, v in
    {"half_life": (18, 28, 72, 168, 48), "stale_after": (60, 84, 240, 720, 168), "search_days": (4, 5, 10, 30, 7), "fresh_bonus": (0.14, 0.1, 0.06, 0.03, 0.08), "stale_penalty": (0.5, 0.56, 0.68, 0.8, 0.62)}.items()}}, "Half-life and limits of news by the question's horizon.")

_QUALITY = double(ladder([(f"contains(lower(outlet), '{k}')", str(v)) for k, v in QUALITY], "1.0"))
rule("str_14_source_quality", "news", {"weight": _QUALITY}, "Trusted outlets weigh more; the first match counts.")
rule("dat_05_influence", "news", {
    "_base": "0.32+0.88*power(0.85, cast(age as double)/48.0)", "_recency": "case when age<=24 then _base+0.08 when age>168 then _base*0.62 else _base end", "recency": r6("_recency"), "_intensity": double("case when level in ('STRONG_BUY', 'STRONG_SELL') then 1.08 else 1.0 end"),
    "influence": r6(f"greatest(0.1, least(2.2, relevance*_recency*{_QUALITY}*_intensity))")}, "Relevance, recency with fresh bonus and stale penalty, outlet and intensity, clamped.")
rule("dat_07_age_labels", "news", {"ago": "case when age<1 then 'just now' when age<24 then cast(age as varchar(9)) || 'h ago' else cast(cast(floor(age/24) as int) as varchar(9)) || 'd ago' end", "days_since": "cast(floor(age/24) as int)"}, "Age as text, and whole days.")
rule("dat_03_session_weight", "news", {"_hour": "age%24", "_weekday": "cast(floor(age/24) as int)%7", "open": "_weekday<5 and _hour*60+(doc_id%60)>=810 and _hour*60+(doc_id%60)<=1200", "weight": double("case when open then 1.15 else 1.0 end")}, "Weekday 13:30 to 20:00 UTC counts as open; live readings weigh more then.")
rule("str_05_client_relevance", "news", {
    "_overlap": "least(n_chars%9, 8)/8.0", "trend": "case doc_id%3 when 0 then 'bullish' when 1 then 'bearish' else 'sideways' end", "_align": double("case when trend='bullish' and level in ('BUY', 'STRONG_BUY') or trend='bearish' and level in ('SELL', 'STRONG_SELL') then 0.18 when trend='sideways' and level='HOLD' then 0.12 else 0.02 end"),
    "_boost": double("case when level in ('STRONG_BUY', 'STRONG_SELL') then 0.08 when level='HOLD' then 0.02 else 0.05 end"), "relevance_score": r6("greatest(0.08, least(0.98, _overlap*0.55+_align+greatest(0.02, 0.2-cast(age as double)/24.0*0.02)+_boost))")}, "Token overlap, agreement with the trend, recency and a boost by label.")
rule("str_16_five_levels", "news", {"klass": "case when level in ('BUY', 'STRONG_BUY') then 'positive' when level='HOLD' then 'neutral' else 'negative' end", "level5": "case klass when 'positive' then case when conf>=0.85 then 'STRONG_BUY' else 'BUY' end when 'negative' then case when conf>=0.85 then 'STRONG_SELL' else 'SELL' end else 'HOLD' end"}, "Three classes become five levels where the class is sure.")
rule("add_07_direction_votes", "news", {
    "agent": "case doc_id%3 when 0 then 'analyst' when 1 then 'market' else 'researcher' end", "payload": "case agent when 'analyst' then case when conf>0.5 then 'up' else 'down' end when 'market' then case when conf>0.6 then 'up' when conf<0.3 then 'down' else 'sideways' end else case when conf>0.6 then 'positive' when conf<0.3 then 'negative' else 'neutral' end end",
    "vote": "case when payload in ('up', 'positive') then 'up' when payload in ('down', 'negative') then 'down' when payload in ('sideways', 'neutral', 'flat') then 'flat' end"}, "Each agent's own words for a direction become one vote.")
rule("mth_12_eps_surprise", "news", {
    "est": double("(doc_id%21-10)/4.0"), "_act": "est*(1+((doc_id%17)-8)/100.0)", "act": r6("_act"), "_diff": "(_act-est)/case when est=0 then 1 else abs(est) end*100", "label": "case when _diff>=3 then 'Beat' when _diff<=-3 then 'Miss' else 'In line' end", "surprise_pct": r6("_diff")}, "Earnings against the estimate, within three percent in line; an estimate of zero is taken as one.")
rule("src_18_earnings_extract", "news", {
    "payload": "'{\"earningsDate\":[{\"raw\":' || cast(1700000000+doc_id*3600 as varchar(20)) || '}],\"trailingPE\":{\"raw\":' || cast(doc_id%40 as varchar(9)) || '}}'", "next_date": "cast(regexp_extract(payload, 'earningsDate.*?raw\":([0-9]+)', 1) as bigint)", "pe": "cast(regexp_extract(payload, 'trailingPE\":.\"raw\":([0-9.]+)', 1) as double)"}, "Values that a vendor wraps as {raw: ...} are unwrapped.")
rule("src_22_provider_filter", "news", {"_primary": "contains(lower(outlet), 'reuters') or contains(lower(outlet), 'bloomberg')", "included": "relevance>0.2", "excluded": "contains(lower(outlet), 'synthetic')", "provider": "case when included and not excluded and _primary then 'primary' when included and not excluded then 'secondary' end"}, "Keyword filters first; the secondary provider counts only for what the primary lacks.")
rule("flt_05_listing_search", "news", {"name": "outlet || ' Holdings'", "exchange": "case doc_id%3 when 0 then 'NYSE' when 1 then 'NASDAQ' else 'LSE' end", "found": "contains(lower(name), 'news') or contains(lower(exchange), 'lse')"}, "A search matches name or exchange, whatever the case.")
rule("add_23_share_slug", "news", {"_own": "case when doc_id%4=0 then 'slug' || cast(doc_id as varchar(20)) end", "slug": "coalesce(_own, substr(md5(cast(doc_id as varchar(20))), 1, 10))"}, "A report keeps its slug and gets one once.")
rule("add_24_market_of_zone", "news", {"zone": "case doc_id%5 when 0 then 'Asia/Kolkata' when 1 then 'Europe/London' when 2 then 'Asia/Tokyo' when 3 then 'America/New_York' end", "market": "coalesce(case zone when 'Asia/Kolkata' then 'IN' when 'Europe/London' then 'GB' when 'Asia/Tokyo' then 'JP' when 'America/New_York' then 'US' end, 'US')"}, "A zone names a market; without one it is US.")
rule("add_20_vendor_quote", "brief", {"country": "case k%4 when 0 then 'IN' when 1 then 'GB' when 2 then 'JP' else 'US' end", "currency": "case country when 'IN' then 'INR' when 'GB' then 'GBP' when 'JP' then 'JPY' else 'USD' end", "change": r6("ret")}, "Vendor quotes with the currency of their country.")

_OUTLOOK = "case when trend='bullish' and conf>=0.6 then 'Positive' when trend='bearish' then 'Cautious' else 'Neutral' end"
rule("add_14_brief_texts", "brief", {
    "price_signal": "case when ret>1 then 'Price trend is improving' when ret<-1 then 'Price trend is weakening' else 'Price trend is mixed' end",
    "news_signal": "case when level in ('BUY', 'STRONG_BUY') then 'News flow leans positive' when level in ('SELL', 'STRONG_SELL') then 'News flow leans negative' else 'News flow looks balanced' end",
    "risk_signal": "case when estimated then 'Using fallback sample data' when risk='low' then 'Risk looks manageable today' when risk='high' then 'Risk looks elevated today' else 'Risk needs patience today' end",
    "pe_band": "case when estimated then 'estimated' when pe>=32 then 'high' when pe>=22 then 'above average' when pe>=14 then 'common' else 'low' end", "momentum": "case when estimated then 'estimated' when ret>=2 then 'rising' when ret<=-2 then 'falling' else 'flat' end",
    "conviction": "case when estimated then 'estimated' when conf*100>=75 then 'aligned' when conf*100>=55 then 'moderate' else 'mixed' end", "outlook": _OUTLOOK, "timeframe": "case when contains(label, 'today') then 'Today' when contains(label, '1-2') then '1-2 sessions' when contains(label, 'week') or contains(label, '5 trading') then '1 week' when contains(label, 'month') then '2-4 weeks' else '1-2 weeks' end",
    "opportunity": "case when estimated then 'estimated' when ret>=2 then 'healthy' when ret<=-1 then 'better after stability' else 'needs confirmation' end", "action": "case when estimated then 'confirm with live prices' when outlook='Positive' then 'add to watchlist' when outlook='Cautious' then 'wait' else 'watch' end"}, "Labels of a brief from forecast, sentiment, risk and whether its data are estimates.")
rule("mth_15_brief_numbers", "brief", {
    "bull_ratio": "cast(floor(greatest(0.0, least(100.0, (score+2)/4*100))+0.5) as int)", "bear_ratio": "100-bull_ratio", "pe_estimate": "floor(greatest(9.0, least(38.0, 18+conf*10-least(band, 8.0)*0.7))*10+0.5)/10", "outlook": _OUTLOOK,
    "suitability": "case when profile='low' and risk='high' then 'Not suited' when outlook='Positive' and (risk='low' or profile='high') then 'Suited for you' when outlook='Cautious' and profile<>'high' then 'Not suited' else 'Neutral' end"}, "Bull ratio, an estimated P/E, and suitability by outlook, risk and profile.")
rule("add_12_forecast_text", "brief", {
    "direction": "case when ret>0.15 then 'upside' when ret<-0.15 then 'downside' else 'range-bound' end", "tape": "case when ret>greatest(0.12, band*0.28) then 'up' when ret<-greatest(0.12, band*0.28) then 'down' else 'flat' end",
    "summary": "'Equity model projects ' || direction || ' over ' || label || ' with ' || trend || ' tape'"}, "Words for a forecast's direction and the tape.")
rule("dec_16_explanation", "brief", {
    "reasons": "'Market Agent shows a ' || trend || '; sentiment reads ' || level", "risks": "'Risk Manager reports ' || risk || ' risk' || case when trend='bullish' and level in ('SELL', 'STRONG_SELL') then '; trend and sentiment conflict' else '' end", "missing": "case when estimated then 'No live price history' else '' end"}, "Reasons, risks and missing evidence as bullets.")
rule("dec_15_outcome_quality", "brief", {
    "available": "not estimated", "researcher": r6("case when available then greatest(0.0, least(1.0, conf*0.7+least(1.0, (k%8)/5.0)*0.3)) else 0.0 end"), "analyst": r6("case when available then greatest(0.0, least(1.0, (50+score*5)/100)) else 0.0 end"),
    "risk_manager": r6("case when available then greatest(0.4, least(1.0, (k*9)%120/90.0)) else 0.0 end"), "market": double("case when not available then 0.0 when k%4=0 then 0.5 else 1.0 end")}, "Quality of each agent's own output, between 0 and 1.")
rule("add_25_arm_directions", "brief", {"direction": "case when ret>0.05 then 'up' when ret<-0.05 then 'down' else 'flat' end", "regime": "case when band>=4 then 'high_vol' when band>=2 then 'mid_vol' else 'low_vol' end", "plan": "'assess:market,analyst,risk'"}, "Direction of the numeric arm with a dead band of 0.05 percent, its regime, and the fixed plan of the other arm.")
