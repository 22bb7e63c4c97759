"""Queries of evaluation runs: intent accuracy, run logs, data audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numeric import rounded
from tidemark.plans.registry import query
from tidemark.plans.rules import ASKS, PHRASES, asks
from tidemark.plans.technical import r6
from tidemark.sources import shared
from tidemark.sources.market import BARS_SQL, bars, table

_GOLD = f"with {ASKS}, p as (select case when contains(low, 'should i') or contains(low, 'buy') or contains(low, 'sell') then 'advice' else 'assess' end as intent, case (conv_id+turn)%12 when 0 then 'advice' when 4 then 'advice' when 8 then 'advice' when 2 then 'define' else 'assess' end as gold, case when (conv_id+turn)%2=0 then 'published' else 'held back' end as provenance from ask)"


@query("agg_35_intent_accuracy", _GOLD + f" select provenance, gold, count(*) as n, {r6('avg(case when intent=gold then 1.0 else 0.0 end)')} as recall, {r6('sum(sum(case when intent=gold then 1.0 else 0.0 end)) over (partition by provenance)/sum(count(*)) over (partition by provenance)')} as accuracy, sum(sum(case when intent=gold then 1.0 else 0.0 end)) over (partition by provenance)/sum(count(*)) over (partition by provenance)>=0.75 as passes from p group by provenance, gold")
def agg_35_intent_accuracy(spark, sf_dir):
    """Recall of each gold intent and accuracy by where the question comes from, against a gate of three quarters."""
    place = (F.col("conv_id") + F.col("turn")) % len(PHRASES)
    intent = F.when(F.contains("low", F.lit("should i")) | F.contains("low", F.lit("buy")) | F.contains("low", F.lit("sell")), "advice").otherwise("assess")
    gold = F.when(place.isin(0, 4, 8), "advice").when(place == 2, "define").otherwise("assess")
    x = asks(spark, sf_dir).select(intent.alias("intent"), gold.alias("gold"), F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, "published").otherwise("held back").alias("provenance"))
    g = x.groupBy("provenance", "gold").agg(F.count("*").alias("n"), F.sum(F.when(F.col("intent") == F.col("gold"), 1.0).otherwise(0.0)).alias("right"))
    all_ = Window.partitionBy("provenance")
    accuracy = F.sum("right").over(all_) / F.sum("n").over(all_)
    return g.select("provenance", "gold", "n", rounded(F.col("right") / F.col("n")).alias("recall"), rounded(accuracy).alias("accuracy"), (accuracy >= 0.75).alias("passes"))


@query("snk_08_run_log", f"select event_type as action, count(*) as runs, {r6('avg(value)')} as mean_ms, min(value) as least, max(value) as most from events group by 1")
def snk_08_run_log(spark, sf_dir):
    """Runs are appended to a CSV log, two batches here, and summed up from it."""
    runs, path = table(spark, sf_dir, "events").select("event_id", "event_type", "value"), shared.folder(spark)
    for batch in (runs.filter("event_id % 2 = 0"), runs.filter("event_id % 2 = 1")):
        batch.write.mode("append").option("header", True).csv(path)
    kept = spark.read.schema(runs.schema).option("header", True).csv(path)
    return kept.groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("runs"), rounded(F.avg("value")).alias("mean_ms"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("src_06_periods", "with p as (select unnest(['3y','6mo','10d','bad']) as period) select period, case when regexp_matches(period,'^[0-9]+d$') then cast(regexp_extract(period,'([0-9]+)',1) as int) when regexp_matches(period,'^[0-9]+mo$') then cast(regexp_extract(period,'([0-9]+)',1) as int)*30 when regexp_matches(period,'^[0-9]+y$') then cast(regexp_extract(period,'([0-9]+)',1) as int)*365 else 1095 end as days from p")
def src_06_periods(spark, sf_dir):
    p = spark.createDataFrame([("3y",), ("6mo",), ("10d",), ("bad",)], "period string")
    n, unit = (F.regexp_extract("period", "^([0-9]+)(d|mo|y)$", g) for g in (1, 2))
    days = F.expr("try_cast(nullif(regexp_extract(period, '^([0-9]+)(d|mo|y)$', 1), '') as int)") * F.when(unit == "d", 1).when(unit == "mo", 30).otherwise(365)
    return p.select("period", F.coalesce(days, F.lit(1095)).alias("days"))


@query("src_08_availability", f"with {BARS_SQL} select symbol, count(*)>=80 as available, case when max(date)>=date '2001-11-01' then 'live' else 'stale' end as tier from bars group by symbol")
def src_08_availability(spark, sf_dir):
    return bars(spark, sf_dir).groupBy("symbol").agg((F.count("*") >= 80).alias("available"), F.when(F.max("date") >= F.lit("2001-11-01").cast("date"), "live").otherwise("stale").alias("tier"))


@query("src_04_ranked_source", f"with {BARS_SQL}, s as (select symbol, date, close, 1 as rank from bars where k%2=0 union all select symbol, date, close+1, 2 from bars) select symbol, date, close, rank from s qualify row_number() over (partition by symbol, date order by rank)=1")
def src_04_ranked_source(spark, sf_dir):
    """The first source that has the row."""
    b = bars(spark, sf_dir)
    s = b.filter("k % 2 = 0").select("symbol", "date", "close", F.lit(1).alias("rank")).unionByName(b.select("symbol", "date", (F.col("close") + 1).alias("close"), F.lit(2).alias("rank")))
    return s.groupBy("symbol", "date").agg(F.min(F.struct("rank", "close")).alias("b")).select("symbol", "date", "b.close", "b.rank")


@query("src_10_candle_repair", f"with {BARS_SQL} select symbol, date, coalesce(case when k%5=0 then null else open end, close) as open, greatest(coalesce(high, close), close, open) as high, least(coalesce(low, close), close, open) as low, coalesce(volume, 0) as volume from bars")
def src_10_candle_repair(spark, sf_dir):
    return bars(spark, sf_dir).select(
        "symbol", "date", F.coalesce(F.when(F.col("k") % 5 != 0, F.col("open")), F.col("close")).alias("open"), F.greatest(F.coalesce("high", "close"), "close", "open").alias("high"),
        F.least(F.coalesce("low", "close"), "close", "open").alias("low"), F.coalesce("volume", F.lit(0.0)).alias("volume"))
