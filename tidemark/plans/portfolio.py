"""Queries over positions, ledgers, paper trades, alerts, watchlists and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.accounts import ACCOUNT, accounts, fires, folded, within_quota
from tidemark.functions.numeric import rounded
from tidemark.plans.registry import query
from tidemark.plans.technical import r6
from tidemark.sources.market import QUOTES_SQL, quotes, table

# Positions: a customer's purchases by brand; amounts are summed in whole cents.
_POS = "pos as (select o_custkey as user_id, p_brand as symbol, sum(l_quantity) as shares, cast(sum(cast(round(l_extendedprice*100) as bigint)) as double)/100 as cost from orders join lineitem on o_orderkey=l_orderkey join part on l_partkey=p_partkey where l_returnflag='N' group by 1, 2)"
_VALUED = f"with {QUOTES_SQL}, {_POS}, v as (select user_id, symbol, sector, shares*price as value, cost, shares*price-cost as pnl from pos join quotes using (symbol))"


def positions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select("l_orderkey", "l_partkey", "l_quantity", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("user_id", "symbol").agg(F.sum("l_quantity").alias("shares"), (F.sum("cents").cast("double") / 100).alias("cost"))


def valued(spark, sf_dir):
    j = positions(spark, sf_dir).join(quotes(spark, sf_dir).select("symbol", "sector", "price"), "symbol")
    return j.withColumn("value", F.col("shares") * F.col("price")).withColumn("pnl", F.col("value") - F.col("cost"))


_WEIGHTS = ", w as (select user_id, sector, sum(value) as sv from v group by 1, 2), t as (select user_id, sector, sv/sum(sv) over (partition by user_id) as share from w)"


@query("agg_14_allocation", _VALUED + _WEIGHTS + f" select user_id, sector, {r6('share')} as share, case when max(share) over (partition by user_id)>0.5 then 'high' when max(share) over (partition by user_id)>0.3 then 'medium' else 'low' end as concentration from t")
def agg_14_allocation(spark, sf_dir):
    user = Window.partitionBy("user_id")
    w = valued(spark, sf_dir).groupBy("user_id", "sector").agg(F.sum("value").alias("sv")).withColumn("share", F.col("sv") / F.sum("sv").over(user))
    top = F.max("share").over(user)
    return w.select("user_id", "sector", rounded(F.col("share")).alias("share"), F.when(top > 0.5, "high").when(top > 0.3, "medium").otherwise("low").alias("concentration"))


@query("agg_14_portfolio_totals", _VALUED + " select user_id, count(*) as positions, count(*) filter (pnl>0) as winners, arg_max(symbol, (pnl, symbol)) as best, arg_min(symbol, (pnl, symbol)) as worst from v group by user_id")
def agg_14_portfolio_totals(spark, sf_dir):
    order = F.struct("pnl", "symbol")
    return valued(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("positions"), F.count_if(F.col("pnl") > 0).alias("winners"), F.max_by("symbol", order).alias("best"), F.min_by("symbol", order).alias("worst"))


@query("agg_15_narrative", _VALUED + " select user_id, 'You hold ' || count(*) || ' positions, ' || count(*) filter (pnl>0) || ' in profit; best is ' || arg_max(symbol, (pnl, symbol)) || '.' as note from v group by user_id")
def agg_15_narrative(spark, sf_dir):
    g = agg_14_portfolio_totals(spark, sf_dir)
    return g.select("user_id", F.format_string("You hold %d positions, %d in profit; best is %s.", "positions", "winners", "best").alias("note"))


_LEDGER = "led as (select o_custkey as user_id, cast(o_orderdate as date) as day, case o_orderstatus when 'F' then 'income' else 'expense' end as kind, cast(round(o_totalprice*100) as bigint) as cents from orders)"


def ledger(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "F", "income").otherwise("expense").alias("kind"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@query("agg_16_ledger_summary", f"with {_LEDGER} select user_id, coalesce(sum(cents) filter (kind='income'),0)::bigint as income, coalesce(sum(cents) filter (kind='expense'),0)::bigint as expense, sum(case when kind='income' then cents else -cents end)::bigint as net, count(*) as entries from led group by user_id")
def agg_16_ledger_summary(spark, sf_dir):
    signed = F.when(F.col("kind") == "income", F.col("cents")).otherwise(-F.col("cents"))
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("cents"))), F.lit(0)).alias(k)
    return ledger(spark, sf_dir).groupBy("user_id").agg(part("income"), part("expense"), F.sum(signed).alias("net"), F.count("*").alias("entries"))


@query("join_11_calendar", f"with {_LEDGER}, ev as (select day, 'ledger' as kind from led union all select cast(ts as date), 'event' from events) select day, count(*) filter (kind='ledger') as ledger_items, count(*) filter (kind='event') as events from ev group by day")
def join_11_calendar(spark, sf_dir):
    days = ledger(spark, sf_dir).select("day", F.lit("ledger").alias("kind")).unionByName(table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.lit("event").alias("kind")))
    return days.groupBy("day").agg(F.count_if(F.col("kind") == "ledger").alias("ledger_items"), F.count_if(F.col("kind") == "event").alias("events"))


@query("add_16_month_grid", "with m as (select unnest(generate_series(date '1998-02-01', date '1998-02-28', interval 1 day))::date as day) select day, cast(dayofweek(date '1998-02-01') as int) as blanks, cast(dayofweek(day) as int) as weekday from m")
def add_16_month_grid(spark, sf_dir):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1998-02-01").cast("date"), F.last_day(F.lit("1998-02-01").cast("date")))).alias("day"))
    return days.select("day", (F.dayofweek(F.lit("1998-02-01").cast("date")) - 1).alias("blanks"), (F.dayofweek("day") - 1).alias("weekday"))


@query("srt_04_latest_per_user", "select o_custkey as user_id, o_orderkey, o_orderdate from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc)<=3")
def srt_04_latest_per_user(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 3").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderdate")


@query("join_03_unscored", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey=o_orderkey and l_returnflag='R')")
def join_03_unscored(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey")


@query("join_04_watchlist_semi", "select event_id, user_id from events where user_id in (select c_custkey from customer where c_acctbal>5000)")
def join_04_watchlist_semi(spark, sf_dir):
    watch = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").join(watch, "user_id", "left_semi").select("event_id", "user_id")


@query("join_08_watchlist_quotes", f"with {QUOTES_SQL}, wl as (select distinct o_custkey as user_id, p_brand as symbol from orders join lineitem on o_orderkey=l_orderkey join part on l_partkey=p_partkey) select user_id, symbol, price, coalesce(sector, 'Unknown') as sector from wl left join quotes using (symbol)")
def join_08_watchlist_quotes(spark, sf_dir):
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    wl = o.join(li, o["o_orderkey"] == li["l_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("o_custkey").alias("user_id"), F.col("p_brand").alias("symbol")).distinct()
    return wl.join(quotes(spark, sf_dir).select("symbol", "price", "sector"), "symbol", "left").select("user_id", "symbol", "price", F.coalesce("sector", F.lit("Unknown")).alias("sector"))


@query("join_10_alerts", "with al as (select c_custkey as alert_id, case when c_custkey%2=0 then 'above' else 'below' end as direction, c_custkey%100 as threshold, ['click','view','purchase','signup','logout'][c_custkey%5+1] as kind from customer), px as (select event_type as kind, max(value) as hi, min(value) as lo from events group by 1) select alert_id, direction from al join px using (kind) where case direction when 'above' then hi>=threshold else lo<=threshold end")
def join_10_alerts(spark, sf_dir):
    """Equality on the instrument, then the threshold by direction."""
    kinds = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "logout")))
    al = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("alert_id"), F.when(F.col("c_custkey") % 2 == 0, "above").otherwise("below").alias("direction"), (F.col("c_custkey") % 100).alias("threshold"), F.element_at(kinds, (F.col("c_custkey") % 5 + 1).cast("int")).alias("kind"))
    px = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    fires = F.when(F.col("direction") == "above", F.col("hi") >= F.col("threshold")).otherwise(F.col("lo") <= F.col("threshold"))
    return al.join(px, "kind").filter(fires).select("alert_id", "direction")


@query("set_04_missing_symbols", "select distinct p_brand as symbol from part where p_size>25 except select distinct p_brand from part join lineitem on p_partkey=l_partkey where l_quantity>=50 and l_discount>=0.1 and l_returnflag='R'")
def set_04_missing_symbols(spark, sf_dir):
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.1 and l_returnflag = 'R'")
    wanted = p.filter("p_size > 25").select(F.col("p_brand").alias("symbol"))
    return wanted.subtract(p.join(li, p["p_partkey"] == li["l_partkey"]).select(F.col("p_brand").alias("symbol")))


@query("set_05_universe", "select distinct upper(p_brand) as symbol from part order by 1 limit 20")
def set_05_universe(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.upper("p_brand").alias("symbol")).distinct().orderBy("symbol").limit(20)


@query("set_06_manifest_compare", "with a as (select p_brand as name, count(*) as rows from part where p_size<=40 group by 1), b as (select p_brand as name, count(*) as rows from part where p_size>10 group by 1) select coalesce(a.name,b.name) as name, case when a.name is null then 'new' when b.name is null then 'missing' when a.rows<>b.rows then 'mismatch' else 'same' end as status from a full outer join b on a.name=b.name")
def set_06_manifest_compare(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a, b = (p.filter(c).groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias(n)) for c, n in (("p_size <= 40", "old"), ("p_size > 10", "now")))
    status = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("old") != F.col("now"), "mismatch").otherwise("same")
    return a.join(b, "name", "full_outer").select("name", status.alias("status"))


@query("snk_06_upsert_latest", "select user_id, arg_max(event_type, (ts, event_id)) as state, count(*) as versions from events group by user_id")
def snk_06_upsert_latest(spark, sf_dir):
    """Latest version wins."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("versions"))


@query("jsn_event_props", "select event_id, cast(json_extract(props, '$.k') as int) as k from events where cast(json_extract(props, '$.k') as int)>5")
def jsn_event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).filter("k > 5")


@query("dat_01_market_open", "select event_id, dayofweek(ts) between 1 and 5 and hour(ts)*60+minute(ts) between 810 and 1200 as open from events")
def dat_01_market_open(spark, sf_dir):
    minutes = F.hour("ts") * 60 + F.minute("ts")
    return table(spark, sf_dir, "events").select("event_id", (F.dayofweek("ts").between(2, 6) & minutes.between(810, 1200)).alias("open"))


@query("dat_02_last_trading_day", "select distinct cast(ts as date) as day, cast(ts as date)-case dayofweek(cast(ts as date)) when 1 then 3 when 0 then 2 else 1 end as last_day from events")
def dat_02_last_trading_day(spark, sf_dir):
    day = F.to_date("ts")
    back = F.when(F.dayofweek(day) == 2, 3).when(F.dayofweek(day) == 1, 2).otherwise(1)
    return table(spark, sf_dir, "events").select(day.alias("day"), F.date_sub(day, back).alias("last_day")).distinct()


@query("dat_04_freshness", "select event_id, " + r6("greatest(0.2, least(1.0, power(0.5, epoch(timestamp '2024-02-01' - ts)/3600/48)*case when event_type='click' and epoch(timestamp '2024-02-01' - ts)<86400 then 1.15 else 1.0 end))") + " as freshness from events")
def dat_04_freshness(spark, sf_dir):
    seconds = F.lit("2024-02-01").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")
    live = F.when((F.col("event_type") == "click") & (seconds < 86400), 1.15).otherwise(1.0)
    return table(spark, sf_dir, "events").select("event_id", rounded(F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.pow(F.lit(0.5), seconds / 3600 / 48) * live))).alias("freshness"))


def in_order(df, *order):
    """Rows dealt by user and sorted by user and ``order``, for a fold that holds one user's state."""
    return df.repartition("user_id").sortWithinPartitions("user_id", *order)


_ORDERED = "e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as rn from events{where})"


@query("stm_01_price_alerts", "with recursive " + _ORDERED.format(where=" where value >= 90") + ", r as (select user_id, event_id, ts, rn, true as fired, ts as last from e where rn=1 union all select e.user_id, e.event_id, e.ts, e.rn, e.ts - r.last >= interval 20 hour, case when e.ts - r.last >= interval 20 hour then e.ts else r.last end from r join e on e.user_id=r.user_id and e.rn=r.rn+1) select user_id, event_id, ts from r where fired")
def stm_01_price_alerts(spark, sf_dir):
    """Alerts at most once in 20 hours for each user: an ordered fold."""
    ticks = table(spark, sf_dir, "events").filter("value >= 90").select("user_id", "event_id", "ts")
    marked = in_order(ticks, "ts", "event_id").mapInPandas(folded(dict, fires), "user_id long, event_id long, ts timestamp, kept boolean")
    return marked.filter("kept").drop("kept")


@query("flt_16_quota", "with recursive " + _ORDERED.format(where="") + ", r as (select user_id, event_id, rn, true as accepted, [ts] as kept from e where rn=1 union all select e.user_id, e.event_id, e.rn, len(list_filter(r.kept, lambda t: e.ts - t < interval 24 hour)) < 3, case when len(list_filter(r.kept, lambda t: e.ts - t < interval 24 hour)) < 3 then list_append(list_filter(r.kept, lambda t: e.ts - t < interval 24 hour), e.ts) else list_filter(r.kept, lambda t: e.ts - t < interval 24 hour) end from r join e on e.user_id=r.user_id and e.rn=r.rn+1) select user_id, event_id, accepted from r")
def flt_16_quota(spark, sf_dir):
    """Rolling 24 hour quota of 3: accepted requests count, rejected ones do not."""
    asked = in_order(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "ts", "event_id")
    return asked.mapInPandas(folded(dict, within_quota), "user_id long, event_id long, ts timestamp, kept boolean").select("user_id", "event_id", F.col("kept").alias("accepted"))


@query("stm_03_message_quota", "with recursive e as (select conv_id as user_id, turn, timestamp '2024-01-01' + to_hours(turn*7) as ts, row_number() over (partition by conv_id order by turn, role) as rn, role from conversations), r as (select user_id, turn, role, rn, true as accepted, [ts] as kept from e where rn=1 union all select e.user_id, e.turn, e.role, e.rn, len(list_filter(r.kept, lambda t: e.ts - t < interval 24 hour)) < 3, case when len(list_filter(r.kept, lambda t: e.ts - t < interval 24 hour)) < 3 then list_append(list_filter(r.kept, lambda t: e.ts - t < interval 24 hour), e.ts) else list_filter(r.kept, lambda t: e.ts - t < interval 24 hour) end from r join e on e.user_id=r.user_id and e.rn=r.rn+1) select user_id, turn, role, accepted from r")
def stm_03_message_quota(spark, sf_dir):
    """The same quota over the turns of a conversation, seven hours apart."""
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("turn") * 7)
    asked = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id"), "turn", "role", ts.alias("ts"))
    kept = in_order(asked, "turn", "role").mapInPandas(folded(dict, within_quota), "user_id long, turn long, role string, ts timestamp, kept boolean")
    return kept.select("user_id", "turn", "role", F.col("kept").alias("accepted"))


@query("stm_04_call_budget", "select event_id, row_number() over (partition by cast(ts as date), event_type order by ts, event_id)<=20 as within from events")
def stm_04_call_budget(spark, sf_dir):
    w = Window.partitionBy(F.to_date("ts"), "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) <= 20).alias("within"))


_TRADES = "tr as (select o_custkey as user_id, cast(substr(p_brand, 7) as int) as k, l_returnflag='R' as sell, l_quantity as shares, p_retailprice as price, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey, l_linenumber, l_partkey, l_quantity) as rn from orders join lineitem on o_orderkey=l_orderkey join part on l_partkey=p_partkey)"
_OK = "case when t.sell then r.held[t.k]>=t.shares else r.cash>=t.shares*t.price end"


@query("stm_05_paper_account", f"with recursive {_TRADES}, u as (select distinct user_id from tr), r as (select user_id, cast(0 as bigint) as rn, 100000.0::double as cash, list_transform(range(25), lambda x: 0.0::double) as held, list_transform(range(25), lambda x: 0.0::double) as costs, 0 as trades, 0 as rejected, 0.0::double as realised from u union all select r.user_id, t.rn, case when {_OK} then r.cash+case when t.sell then t.shares*t.price else -t.shares*t.price end else r.cash end, list_transform(range(1, 26), lambda i: case when {_OK} and i=t.k then case when t.sell then r.held[i]-t.shares else r.held[i]+t.shares end else r.held[i] end), list_transform(range(1, 26), lambda i: case when {_OK} and i=t.k and not t.sell then (r.held[i]*r.costs[i]+t.shares*t.price)/(r.held[i]+t.shares) else r.costs[i] end), r.trades+case when {_OK} then 1 else 0 end, r.rejected+case when {_OK} then 0 else 1 end, case when {_OK} and t.sell then r.realised+t.shares*(t.price-r.costs[t.k]) else r.realised end from r join tr t on t.user_id=r.user_id and t.rn=r.rn+1), z as (select *, row_number() over (partition by user_id order by rn desc) as newest from r) select user_id, floor(cash*100+0.5)/100 as cash, cast(len(list_filter(held, lambda h: h>0)) as int) as holdings, trades, rejected, floor(realised*100+0.5)/100 as realised from z where newest=1")
def stm_05_paper_account(spark, sf_dir):
    """Cash and average-cost positions; overspending and overselling are rejected, which feeds back."""
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    trades = o.join(li, o["o_orderkey"] == li["l_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"]).select(
        F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey", "l_linenumber", "l_partkey", F.col("p_brand").alias("symbol"), (F.col("l_returnflag") == "R").alias("sell"), F.col("l_quantity").alias("shares"), F.col("p_retailprice").alias("price"))
    x = in_order(trades, "o_orderdate", "o_orderkey", "l_linenumber", "l_partkey", "shares").mapInPandas(accounts, ACCOUNT)
    return x.withColumns({c: rounded(F.col(c), 2) for c in ("cash", "realised")})


@query("agg_17_paper_valuation", f"with {QUOTES_SQL}, {_POS} select user_id, {r6('sum(shares*price)/sum(cost)-1')} as total_return, count(*) as holdings from pos join quotes using (symbol) group by user_id")
def agg_17_paper_valuation(spark, sf_dir):
    return valued(spark, sf_dir).groupBy("user_id").agg(rounded(F.sum("value") / F.sum("cost") - 1).alias("total_return"), F.count("*").alias("holdings"))


@query("stm_06_reliability_prefix", f"select event_id, {r6('coalesce((sum(case when value>50 then 1 else 0 end) over w+0.75*4)/(count(*) over w+4), 0.75)')} as reliability from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)")
def stm_06_reliability_prefix(spark, sf_dir):
    """Read before write: the frame ends one row earlier."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    hits = F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).over(w)
    return table(spark, sf_dir, "events").select("event_id", rounded(F.coalesce((hits + 0.75 * 4) / (F.count("*").over(w) + 4), F.lit(0.75))).alias("reliability"))


@query("agg_38_reliability", f"select user_id, event_type as context, {r6('(sum(case when value>50 then 1 else 0 end)+3.0)/(count(*)+4)')} as reliability, {r6('least(1.0,count(*)/15.0)')} as blend from events group by 1, 2")
def agg_38_reliability(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("context")).agg(rounded((F.sum(F.when(F.col("value") > 50, 1).otherwise(0)) + 3.0) / (n + 4)).alias("reliability"), rounded(F.least(F.lit(1.0), n / 15.0)).alias("blend"))


@query("agg_40_unread", "select user_id, count(*) filter (event_type<>'view') as unread from events group by user_id")
def agg_40_unread(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "view").alias("unread"))


@query("ext_tumbling_bars", f"select event_type as symbol, time_bucket(interval 1 hour, ts) as start, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*) as ticks from events group by 1, 2")
def ext_tumbling_bars(spark, sf_dir):
    order = F.struct("ts", "event_id")
    b = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.window("ts", "1 hour").alias("w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("ticks"))
    return b.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "ticks")
