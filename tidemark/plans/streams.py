"""Queries that run as streams: the same windows over a file source, until it is drained."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.plans.portfolio import _ORDERED
from tidemark.plans.registry import query
from tidemark.plans.store import _LOG, predictions
from tidemark.plans.technical import r6
from tidemark.sources import shared
from tidemark.sources.market import QUOTES_SQL, changes, indexed, table
from tidemark.streaming.bars import session_stats, tumbling_bars
from tidemark.streaming.keyed import alert_stream, digest_days, quota_stream
from tidemark.streaming.scoring import Scorer


def _drained(spark, stream):
    """All output of a bounded stream, from files that the executors write; its state and progress lie beside them."""
    path = shared.folder(spark)
    running = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


_LAST = "(select max(ts) from events)"


@query("stm_ohlc_stream", f"select event_type as symbol, time_bucket(interval 1 hour, ts) as start, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*) as ticks from events group by 1, 2 having time_bucket(interval 1 hour, ts) + interval 1 hour <= {_LAST} - interval 1 hour")
def stm_ohlc_stream(spark, sf_dir):
    """Hourly bars of the event stream with a one-hour watermark; the last hour stays open."""
    schema = table(spark, sf_dir, "events").schema
    ticks = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _drained(spark, tumbling_bars(ticks.withColumn("ts", F.col("ts").cast("timestamp"))))


@query("stm_sessions_stream", f"with g as (select user_id, ts, value, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hour then 1 else 0 end as fresh, event_id from events), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as part from g) select user_id, min(ts) as start, max(ts) + interval 6 hour as end, count(*) as ticks, floor(sum(value)*1e6+0.5)/1e6 as total from s group by user_id, part having max(ts) + interval 6 hour <= {_LAST} - interval 1 hour")
def stm_sessions_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    ticks = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _drained(spark, session_stats(ticks.withColumn("ts", F.col("ts").cast("timestamp"))))


# --- Keyed state: alerts, quotas, digests, matured outcomes ------------------
def _events(spark, sf_dir):
    """The table events as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def price_alerts(spark, sf_dir):
    """An alert of each customer on the ticks of one kind: rich customers want to hear daily, those of the first nations of rises."""
    kinds = F.create_map(*(F.lit(x) for pair in zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), ("click", "error", "purchase", "signup", "view"), strict=True) for x in pair))
    above = F.col("c_nationkey") < 13
    threshold = F.when(above, 100 + (F.col("c_acctbal") + 1000) / 40).otherwise((F.col("c_acctbal") + 1000) / 2200)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("alert_id"), F.col("c_custkey").alias("user_id"), kinds[F.col("c_mktsegment")].alias("symbol"), F.when(above, "above").otherwise("below").alias("direction"),
        threshold.cast("double").alias("threshold"), F.when(F.col("c_acctbal") >= 5000, "daily").otherwise("once").alias("cadence"))


_ALERTS_SQL = """al as (select c_custkey as alert_id, list_extract(['click', 'error', 'purchase', 'signup', 'view'], list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment)) as symbol,
  c_nationkey < 13 as above, case when c_nationkey < 13 then 100 + (c_acctbal + 1000) / 40 else (c_acctbal + 1000) / 2200 end as threshold, c_acctbal >= 5000 as daily from customer)"""


@query("stm_01_alert_stream", f"""with recursive {_ALERTS_SQL},
hit as materialized (select alert_id, symbol, daily, event_id, ts, value as price, row_number() over (partition by alert_id order by ts, event_id) as rn from al join events on event_type = symbol and case when above then value >= threshold else value <= threshold end),
r as (select alert_id, rn, ts as last, true as fired from hit where rn = 1
  union all select h.alert_id, h.rn, case when h.ts - r.last >= interval 20 hour then h.ts else r.last end, h.ts - r.last >= interval 20 hour from r join hit h on h.alert_id = r.alert_id and h.rn = r.rn + 1 and h.daily)
select alert_id, alert_id as user_id, symbol, event_id, ts, price from r join hit using (alert_id, rn) where fired""")
def stm_01_alert_stream(spark, sf_dir):
    """Each customer's price alert over the tick stream: ``once`` fires and goes, ``daily`` rests for 20 hours."""
    ticks = _events(spark, sf_dir).select(F.col("event_type").alias("symbol"), "event_id", "ts", F.col("value").alias("price"))
    return _drained(spark, alert_stream(ticks, price_alerts(spark, sf_dir)))


@query("stm_03_quota_stream", "with recursive " + _ORDERED.format(where="").replace("e as", "e as materialized") + ", r as (select user_id, event_id, rn, true as accepted, [ts] as kept from e where rn=1 union all select e.user_id, e.event_id, e.rn, len(list_filter(r.kept, lambda t: e.ts - t < interval 24 hour)) < 3, case when len(list_filter(r.kept, lambda t: e.ts - t < interval 24 hour)) < 3 then list_append(list_filter(r.kept, lambda t: e.ts - t < interval 24 hour), e.ts) else list_filter(r.kept, lambda t: e.ts - t < interval 24 hour) end from r join e on e.user_id=r.user_id and e.rn=r.rn+1) select user_id, event_id, accepted from r")
def stm_03_quota_stream(spark, sf_dir):
    """The rolling 24 hour quota of 3 as keyed state; a timer forgets users who have been still for a day."""
    return _drained(spark, quota_stream(_events(spark, sf_dir))).select("user_id", "event_id", "accepted")


# The markets of the digest and their zones.
MARKETS = (("US", "America/New_York", "United States"), ("IN", "Asia/Kolkata", "India"), ("GB", "Europe/London", "United Kingdom"), ("JP", "Asia/Tokyo", "Japan"), ("CN", "Asia/Shanghai", "China"))


def movers(spark, sf_dir):
    """user_id, market, body: the watched symbols of each market in order, with their change in percent."""
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    watched = o.join(li.filter("l_returnflag = 'A'"), F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").alias("user_id"), F.col("p_brand").alias("symbol")).distinct()
    cents = F.floor(F.abs("change_pct") * 100 + 0.5).cast("long")
    line = F.concat("symbol", F.when(F.col("change_pct") >= 0, " +").otherwise(" -"), F.expr("string(cents div 100)"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), F.lit("%"))
    moved = changes(spark, sf_dir).filter("change_pct is not null").withColumn("cents", cents).select("symbol", (F.col("k") % len(MARKETS) + 1).cast("int").alias("place"), line.alias("line"))
    codes = F.array(*(F.lit(m[0]) for m in MARKETS))
    found = watched.join(F.broadcast(moved), "symbol").withColumn("market", F.element_at(codes, F.col("place")))
    # One line a symbol of the market, which the symbol dimension bounds.
    return found.groupBy("user_id", "market").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol", "line"))), lambda x: x["line"]), "  ·  ").alias("body"))


def digests(due, markets, bodies):
    """Each body on each day that is due in its market.

    The due days are few and go to the bodies, which stay where they are: a shuffle by market
    would make each market one task's work.
    """
    days = due.join(F.broadcast(markets.select("market", "name")), "market").select("market", "day", F.concat(F.lit("Morning Brief — "), "name").alias("title"))
    return bodies.join(F.broadcast(days), "market").select("user_id", "market", "day", "title", "body")


_ZONES_SQL = ", ".join(f"('{code}', '{zone}', '{name}')" for code, zone, name in MARKETS)


@query("stm_02_digest_stream", f"""with {QUOTES_SQL}, mk as (select * from (values {_ZONES_SQL}) t(market, zone, name)),
due as (select distinct market, name, cast(loc as date) as day from (select market, name, timezone(zone, timezone('UTC', ts)) as loc from events cross join mk) where hour(loc) = 9 and dayofweek(loc) between 1 and 5),
w as (select distinct o_custkey as user_id, p_brand as symbol from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey where l_returnflag = 'A'),
ln as (select user_id, symbol, list_extract(['US', 'IN', 'GB', 'JP', 'CN'], k % 5 + 1) as market, symbol || case when change_pct >= 0 then ' +' else ' -' end || (c // 100) || '.' || lpad((c % 100)::varchar, 2, '0') || '%' as line
  from w join (select symbol, k, change_pct, cast(floor(abs(change_pct) * 100 + 0.5) as bigint) as c from quotes where change_pct is not null) using (symbol)),
bd as (select user_id, market, string_agg(line, '  ·  ' order by symbol) as body from ln group by 1, 2)
select user_id, market, day, 'Morning Brief — ' || name as title, body from due join bd using (market)""")
def stm_02_digest_stream(spark, sf_dir):
    """At nine o'clock local time on weekdays, once a market and day, each user's movers of that market in one line.

    The tick stream is the clock: the first tick from nine to ten makes the digest.
    """
    markets = spark.createDataFrame(list(MARKETS), "market string, zone string, name string")
    bodies = shared.stored(movers(spark, sf_dir))
    due = digest_days(_events(spark, sf_dir), markets.select("market", "zone"))
    return _drained(spark, digests(due, markets, bodies))


@query("stm_07_scored_stream", _LOG + f", sc as (select decision_id, direction, fwd, case when fwd > 0.0005 then 'up' when fwd < -0.0005 then 'down' else 'flat' end as realised from lg where fwd is not null) select decision_id, direction, realised, {r6('fwd')} as ret, direction = realised as correct from sc")
def stm_07_scored_stream(spark, sf_dir):
    """Predictions arrive in three drops, with the bars known by then; each is scored once, when its five bars are over."""
    bars = shared.stored(indexed(spark, sf_dir).select("symbol", F.col("date").alias("as_of"), "close", F.floor(F.col("i") * 3 / F.col("n")).cast("int").alias("drop")))
    made = predictions(spark, sf_dir).select("decision_id", "symbol", "as_of", "direction", "arm")
    made = shared.stored(made.join(bars.select("symbol", "as_of", "drop"), ["symbol", "as_of"]))
    now = {"drop": 0}

    def score(rows):
        known = bars.filter(F.col("drop") <= now["drop"])
        later = known.select("symbol", "as_of", (F.lead("close", 5).over(Window.partitionBy("symbol").orderBy("as_of")) / F.col("close") - 1).alias("realised"))
        return rows.join(later, ["symbol", "as_of"], "left")

    path = shared.folder(spark)
    scorer = Scorer(spark, path, made.drop("drop").schema, "decision_id", score)
    for drop in range(3):
        now["drop"] = drop
        made.filter(F.col("drop") == drop).drop("drop").write.mode("append").parquet(f"{path}/arrived")
        scorer.drain(f"{path}/arrived")
    word = F.when(F.col("realised") > 0.0005, "up").when(F.col("realised") < -0.0005, "down").otherwise("flat")
    return scorer.outcomes().select("decision_id", "direction", word.alias("realised"), rounded(F.col("realised")).alias("ret"), (F.col("direction") == word).alias("correct"))
