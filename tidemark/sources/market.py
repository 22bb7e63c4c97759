"""Market tables derived from the base tables: bars, market series, quotes, articles.

Bars come from line items by brand and ship date.  The discount plays the part of a
return; whole cents are summed before dividing, so closes agree to the last digit on any
engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numeric import rounded

def by_date():
    """Each symbol's bars in order."""
    return Window.partitionBy("symbol").orderBy("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def last(n: int):
    """The current bar and the n - 1 before it."""
    return by_date().rowsBetween(-(n - 1), 0)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, k, date, open, high, low, close, volume."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"), F.expr("cast(substr(p_brand, 7) as int)").alias("k"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), F.round(F.col("l_discount") * 100).cast("long").alias("d"), "l_quantity")
    days = (
        lines.join(part, lines["l_partkey"] == part["p_partkey"])
        .groupBy("symbol", "k", "date")
        .agg(F.sum("d").alias("s"), F.count("*").alias("n"), F.max("d").alias("mx"), F.min("d").alias("mn"), F.sum("l_quantity").alias("volume"))
    )
    av, sc = F.col("s").cast("double") / F.col("n"), F.lit(0.5) + F.lit(0.5) * (F.col("k") % 3)
    days = days.withColumn("av", av).withColumn("sc", sc).withColumn("r", F.col("sc") * (F.col("av") / 100 - 0.05))
    close = rounded(100 * F.exp(F.sum(F.log(1 + F.col("r"))).over(by_date())), 4)
    priced = days.withColumn("close", close)
    return priced.select(
        "symbol", "k", "date", F.coalesce(F.lag("close").over(by_date()), F.col("close")).alias("open"),
        rounded(F.col("close") * (1 + 0.5 * F.col("sc") * (F.col("mx") - F.col("av")) / 100), 4).alias("high"),
        rounded(F.col("close") * (1 - 0.5 * F.col("sc") * (F.col("av") - F.col("mn")) / 100), 4).alias("low"),
        "close", "volume",
    )


BARS_SQL = """
days as (
  select p_brand as symbol, cast(substr(p_brand, 7) as int) as k, cast(l_shipdate as date) as date,
         sum(cast(round(l_discount*100) as bigint)) as s, count(*) as n, max(cast(round(l_discount*100) as bigint)) as mx,
         min(cast(round(l_discount*100) as bigint)) as mn, sum(l_quantity) as volume
  from lineitem join part on l_partkey = p_partkey group by 1, 2, 3),
rets as (select *, cast(s as double)/n as av, 0.5+0.5*(k%3) as sc, (0.5+0.5*(k%3))*((cast(s as double)/n)/100-0.05) as r from days),
priced as (select *, floor(100*exp(sum(ln(1+r)) over (partition by symbol order by date))*10000+0.5)/10000 as close from rets),
bars as (
  select symbol, k, date, coalesce(lag(close) over (partition by symbol order by date), close) as open,
         floor(close*(1+0.5*sc*(mx-av)/100)*10000+0.5)/10000 as high, floor(close*(1-0.5*sc*(av-mn)/100)*10000+0.5)/10000 as low,
         close, volume from priced)"""


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with i (bar number from 0), n (bars of the symbol) and ret (simple return)."""
    b = bars(spark, sf_dir)
    before = F.lag("close").over(by_date())
    return b.withColumn("i", F.row_number().over(by_date()) - 1).withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).withColumn("ret", (F.col("close") - before) / before)


INDEXED_SQL = BARS_SQL + """,
ix as (select *, row_number() over w - 1 as i, count(*) over (partition by symbol) as n,
       (close-lag(close) over w)/lag(close) over w as ret from bars window w as (partition by symbol order by date))"""


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, mret and mclose of the whole market."""
    d = F.round(F.col("l_discount") * 100).cast("long")
    days = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum(d).alias("s"), F.count("*").alias("n"))
    # One row a date: the calendar bounds the single partition of this window.
    path = Window.partitionBy(F.lit(0)).orderBy("date")
    r = F.col("s").cast("double") / F.col("n") / 100 - 0.05
    return days.select("date", r.alias("mret"), rounded(100 * F.exp(F.sum(F.log(1 + r)).over(path)), 4).alias("mclose"))


MARKET_SQL = """
market as (select date, mret, floor(100*exp(sum(ln(1+mret)) over (order by date))*10000+0.5)/10000 as mclose from (
  select cast(l_shipdate as date) as date, cast(sum(cast(round(l_discount*100) as bigint)) as double)/count(*)/100-0.05 as mret from lineitem group by 1))"""


def _change_pct():
    return rounded((F.col("close") - F.col("prev")) / F.col("prev") * 100).alias("change_pct")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, k and change_pct of each symbol's latest bar, as ``quotes`` has them, from one pass over the lines."""
    x = indexed(spark, sf_dir).select("symbol", "k", "close", "i", "n", F.lag("close").over(by_date()).alias("prev"))
    return x.filter(F.col("i") == F.col("n") - 1).select("symbol", "k", _change_pct())


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest bar of each symbol with averages, range, beta and fundamentals."""
    x = indexed(spark, sf_dir).join(market(spark, sf_dir), "date", "left")
    x = x.select(
        "symbol", "k", "date", "close", "volume", "i", "n", F.lag("close").over(by_date()).alias("prev"),
        F.when(F.col("i") >= 49, F.avg("close").over(last(50))).alias("ma50"), F.when(F.col("i") >= 199, F.avg("close").over(last(200))).alias("ma200"),
        F.max("close").over(last(252)).alias("hi52"), F.min("close").over(last(252)).alias("lo52"), F.avg("volume").over(last(20)).alias("avg_volume"), "ret", "mret",
    )
    beta = x.groupBy("symbol").agg(F.regr_slope("ret", "mret").alias("beta"))
    newest = x.filter(F.col("i") == F.col("n") - 1).drop("ret", "mret").join(beta, "symbol")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"), "l_tax")
    on_day = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    day = newest.select(F.col("symbol").alias("s"), F.col("date").alias("d"))
    facts = on_day.join(day, (F.col("p_brand") == F.col("s")) & (F.col("day") == F.col("d"))).groupBy(F.col("s").alias("symbol")).agg(
        F.avg("p_size").alias("size"), (F.sum(F.round(F.col("l_tax") * 100).cast("long")).cast("double") / F.count("*")).alias("yield_pct"))
    types = part.groupBy(F.col("p_brand").alias("symbol"), "p_type").agg(F.count("*").alias("c")).groupBy("symbol").agg(F.min_by("p_type", F.struct(-F.col("c"), "p_type")).alias("sector"))
    out = newest.join(facts, "symbol", "left").join(types, "symbol", "left")
    return out.select(
        "symbol", "k", "date", F.col("close").alias("price"), F.col("prev").alias("last_close"), _change_pct(),
        rounded(F.col("ma50")).alias("ma50"), rounded(F.col("ma200"), 8).alias("ma200"), "hi52", "lo52", "volume", rounded(F.col("avg_volume")).alias("avg_volume"), rounded(F.col("beta")).alias("beta"),
        (F.col("close") * F.col("volume") * F.pow(F.lit(10.0), 6 + F.col("k") % 4)).alias("market_cap"),
        F.when(F.col("k") % 7 != 0, rounded(F.col("size"))).alias("pe_ratio"), rounded(F.col("yield_pct")).alias("dividend_yield"), "sector",
    )


QUOTES_SQL = INDEXED_SQL + "," + MARKET_SQL + """,
rolled as (select symbol, k, date, close, volume, i, n, lag(close) over w as prev,
   case when i>=49 then avg(close) over (partition by symbol order by date rows between 49 preceding and current row) end as ma50,
   case when i>=199 then avg(close) over (partition by symbol order by date rows between 199 preceding and current row) end as ma200,
   max(close) over (partition by symbol order by date rows between 251 preceding and current row) as hi52,
   min(close) over (partition by symbol order by date rows between 251 preceding and current row) as lo52,
   avg(volume) over (partition by symbol order by date rows between 19 preceding and current row) as avg_volume
   from ix window w as (partition by symbol order by date)),
betas as (select symbol, regr_slope(ret, mret) as beta from ix left join market using (date) group by symbol),
newest as (select * from rolled where i = n-1),
facts as (select p_brand as symbol, avg(p_size) as size, cast(sum(cast(round(l_tax*100) as bigint)) as double)/count(*) as yield_pct
   from lineitem join part on l_partkey=p_partkey join newest on p_brand=symbol and cast(l_shipdate as date)=newest.date group by 1),
types as (select symbol, p_type as sector from (select p_brand as symbol, p_type, row_number() over (partition by p_brand order by count(*) desc, p_type) as rk from part group by 1, 2) where rk=1),
quotes as (select symbol, k, date, close as price, prev as last_close, floor((close-prev)/prev*100*1e6+0.5)/1e6 as change_pct,
   floor(ma50*1e6+0.5)/1e6 as ma50, floor(ma200*1e8+0.5)/1e8 as ma200, hi52, lo52, volume, floor(avg_volume*1e6+0.5)/1e6 as avg_volume, floor(beta*1e6+0.5)/1e6 as beta,
   close*volume*power(10.0, 6+k%4) as market_cap, case when k%7<>0 then floor(size*1e6+0.5)/1e6 end as pe_ratio, floor(yield_pct*1e6+0.5)/1e6 as dividend_yield, sector
   from newest left join betas using (symbol) left join facts using (symbol) left join types using (symbol))"""
