"""Queries of the sealed prediction log: ids, seals, outcomes, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.operators import log, manifest
from tidemark.plans.decision import _HEAD, evidence
from tidemark.plans.registry import query
from tidemark.plans.technical import r6
from tidemark.sources import shared
from tidemark.sources.commits import CommittedTable
from tidemark.sources.market import INDEXED_SQL, indexed, table

_LOG = _HEAD + ", lg as (select symbol, date as as_of, i, fwd, arm, case when arm='A' then case when mom>0 then 'up' else 'down' end else 'up' end as direction, substr(sha256(strftime(date,'%Y-%m-%d')||'|'||symbol||'|'||arm||'|5'),1,16) as decision_id from ev cross join (select unnest(['A','B']) as arm))"


def predictions(spark, sf_dir):
    arms = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("arm")
    x = evidence(spark, sf_dir).select("symbol", F.col("date").alias("as_of"), "i", "mom", "fwd", arms)
    direction = F.when(F.col("arm") == "B", "up").when(F.col("mom") > 0, "up").otherwise("down")
    return log.sealed(x.withColumn("direction", direction).withColumn("horizon", F.lit(5)))


@query("snk_03_decision_ids", _LOG + " select symbol, as_of, arm, decision_id, sha256(decision_id||'|'||direction) as seal from lg")
def snk_03_decision_ids(spark, sf_dir):
    return predictions(spark, sf_dir).select("symbol", "as_of", "arm", "decision_id", "seal")


@query("snk_01_append", _LOG + " select arm, count(*) as rows, count(distinct decision_id) as ids from lg group by arm")
def snk_01_append(spark, sf_dir):
    """The log is appended in two overlapping parts and once again whole; each key is stored once."""
    p = predictions(spark, sf_dir)
    store = shared.Store(spark, shared.folder(spark), p.schema, ["symbol", "as_of", "arm", "horizon"])
    for part in (p.filter("i < 700"), p.filter("i >= 600"), p):
        store.append(part)
    return store.read().groupBy("arm").agg(F.count("*").alias("rows"), F.count_distinct("decision_id").alias("ids"))


_DIGESTS = """{name} as (select symbol, count(*) as rows, min(date) as first_day, max(date) as last_day, count(*) filter (abs(ret) > 0.05) as jumps,
  sha256(count(*) || '|' || sum(cast('0x' || substr(h, 1, 15) as bigint)) || '|' || sum(cast('0x' || substr(h, 17, 15) as bigint))) as digest
  from (select symbol, date, ret, sha256(strftime(date, '%Y-%m-%d') || '|' || cast(floor(close*100+0.5) as bigint) || '|' || cast(floor(volume+0.5) as bigint)) as h from {rows}) group by symbol)"""


@query("snk_04_manifest", f"""with {INDEXED_SQL}, old as (select symbol, date, ret, case when symbol='Brand#5' and i=n-1 then close+0.01 else close end as close, volume from ix where symbol<>'Brand#3' union all select 'Brand#99', date, ret, close, volume from ix where symbol='Brand#7'),
{_DIGESTS.format(name='now', rows='ix')}, {_DIGESTS.format(name='was', rows='old')}
select coalesce(n.symbol, w.symbol) as symbol, n.rows, n.first_day, n.last_day, n.jumps, n.digest, case when w.symbol is null then 'new' when n.symbol is null then 'missing' when n.digest<>w.digest then 'mismatch' else 'ok' end as status from now n full outer join was w on n.symbol=w.symbol""")
def snk_04_manifest(spark, sf_dir):
    """Of each symbol's bars: rows, first and last day, jumps and the digest of the contents, against a recorded manifest.

    The record was taken before one symbol came, another went, and one close moved by a cent.
    """
    x = shared.stored(indexed(spark, sf_dir).select("symbol", "date", "i", "n", "ret", "close", "volume"))
    content = [F.date_format("date", "yyyy-MM-dd"), F.floor(F.col("close") * 100 + 0.5), F.floor(F.col("volume") + 0.5)]
    facts = {"first_day": F.min("date"), "last_day": F.max("date"), "jumps": F.count_if(F.abs("ret") > 0.05)}
    moved = F.when((F.col("symbol") == "Brand#5") & (F.col("i") == F.col("n") - 1), F.col("close") + 0.01).otherwise(F.col("close"))
    old = x.filter("symbol <> 'Brand#3'").withColumn("close", moved).union(x.filter("symbol = 'Brand#7'").withColumn("symbol", F.lit("Brand#99")))
    now = manifest.digests(x, ["symbol"], content, facts)
    return manifest.compared(now, manifest.digests(old, ["symbol"], content), "symbol").select("symbol", "rows", "first_day", "last_day", "jumps", "digest", "status")


@query("snk_01_committed_log", _LOG + " select arm, count(*) as rows, count(distinct decision_id) as ids from lg group by arm")
def snk_01_committed_log(spark, sf_dir):
    """The log as a committed table: three overlapping appends, each a version; what is held stays."""
    p = shared.stored(predictions(spark, sf_dir))
    log_table = CommittedTable(spark, shared.folder(spark), p.schema, ["decision_id"])
    for part in (p.filter("i < 700"), p.filter("i >= 600"), p):
        log_table.upsert(part, ["as_of"], update=False)
    return log_table.read().groupBy("arm").agg(F.count("*").alias("rows"), F.count_distinct("decision_id").alias("ids"))


def _order_writes(spark, sf_dir):
    """Writes of a customer's newest order, in three parts by year."""
    year = F.year("o_orderdate")
    return shared.stored(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("string").alias("day"), F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"), F.when(year < 1996, 0).when(year < 1998, 1).otherwise(2).alias("part")))


def _written(spark, sf_dir, update):
    writes = _order_writes(spark, sf_dir)
    held = CommittedTable(spark, shared.folder(spark), writes.drop("part").schema, ["user_id"], buckets=8)
    for part in range(3):
        held.upsert(writes.filter(F.col("part") == part), ["day", "order_id"], update)
    return held


_PICKED = "select user_id, max(case when place = 1 then order_id end) as order_id, max(case when place = 1 then total end) as total from (select o_custkey as user_id, o_orderkey as order_id, o_totalprice as total, row_number() over (partition by o_custkey order by o_orderdate {way}, o_orderkey {way}) as place from orders) group by user_id"


@query("snk_06_do_update", _PICKED.format(way="desc"))
def snk_06_do_update(spark, sf_dir):
    """Three upserts into a committed table: the newest order of each customer stays."""
    return _written(spark, sf_dir, True).read().select("user_id", "order_id", "total")


@query("snk_06_do_nothing", _PICKED.format(way="asc"))
def snk_06_do_nothing(spark, sf_dir):
    """The same writes where a held key is left alone: the oldest order stays."""
    return _written(spark, sf_dir, False).read().select("user_id", "order_id", "total")


@query("snk_06_versions", f"""with w as (select o_custkey, o_orderdate, o_orderkey, o_totalprice, case when year(o_orderdate) < 1996 then 1 when year(o_orderdate) < 1998 then 2 else 3 end as part from orders),
v as (select version, o_custkey, o_totalprice, row_number() over (partition by version, o_custkey order by o_orderdate desc, o_orderkey desc) as place from w join (select unnest([1, 2, 3]) as version) on part <= version)
select version, count(*) as rows, floor(sum(o_totalprice)*100+0.5)/100 as total from v where place = 1 group by version""")
def snk_06_versions(spark, sf_dir):
    """Every version of the table can be read back."""
    held = _written(spark, sf_dir, True)
    parts = [held.read(v).agg(F.lit(v).alias("version"), F.count("*").alias("rows"), rounded(F.sum("total"), 2).alias("total")) for v in held.versions()]
    return reduce(lambda a, b: a.union(b), parts)


@query("snk_09_resume", f"with {INDEXED_SQL} select symbol, count(*) as bars, {r6('sum(ret)')} as total from ix group by symbol")
def snk_09_resume(spark, sf_dir):
    """A run that stopped after some symbols goes on with the others; the result is that of one run."""
    x = indexed(spark, sf_dir).select("symbol", "i", "ret")
    path = shared.folder(spark)
    shared.resumed(spark, path, x.filter("symbol < 'Brand#15'"), "symbol")
    done = shared.resumed(spark, path, x, "symbol")
    return done.groupBy("symbol").agg(F.count("*").alias("bars"), rounded(F.sum("ret")).alias("total"))


@query("agg_20_arm_summary", _LOG + f" select arm, count(*) as n, count(distinct symbol) as tickers, {r6('avg(case when (fwd>0)=(direction=chr(117)||chr(112)) then 1.0 else 0.0 end)')} as accuracy from lg where fwd is not null group by arm")
def agg_20_arm_summary(spark, sf_dir):
    right = (F.col("fwd") > 0) == (F.col("direction") == "up")
    return predictions(spark, sf_dir).filter("fwd is not null").groupBy("arm").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("tickers"), rounded(F.avg(F.when(right, 1.0).otherwise(0.0))).alias("accuracy"))


@query("join_02_outcomes", _LOG + f" select decision_id, {r6('fwd')} as realised, (fwd>0)=(direction='up') as correct from lg where fwd is not null")
def join_02_outcomes(spark, sf_dir):
    p = predictions(spark, sf_dir)
    outcomes = evidence(spark, sf_dir).filter("fwd is not null").select("symbol", F.col("date").alias("as_of"), F.col("fwd").alias("realised"))
    return p.join(outcomes, ["symbol", "as_of"]).select("decision_id", rounded(F.col("realised")).alias("realised"), ((F.col("realised") > 0) == (F.col("direction") == "up")).alias("correct"))
