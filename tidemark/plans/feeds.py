"""Queries over feeds: vendor rows, payloads, validation, lessons, idempotent writes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.registry import query
from tidemark.sources import shared
from tidemark.sources.files import clean_prices
from tidemark.sources.market import INDEXED_SQL, indexed, table


@query("src_01_vendor_prices", "select p_partkey, date '2024-01-01' + p_size as date, p_retailprice as close, cast(p_partkey as double) as volume from part where p_partkey % 7 <> 0")
def src_01_vendor_prices(spark, sf_dir):
    """Rows as a vendor sends them, one in seven a repeated header."""
    header = F.col("p_partkey") % 7 == 0
    raw = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(header, "Date").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("string")).alias(" Date"),
        F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("Close/Last"), F.format_number("p_partkey", 0).alias("VOLUME"))
    return clean_prices(raw, "p_partkey")


@query("src_07_chart_payload", "select p_partkey, p_size as t, p_retailprice as close from part")
def src_07_chart_payload(spark, sf_dir):
    """Parallel arrays of a JSON payload become rows; null closes go."""
    payload = F.to_json(F.struct(F.array("p_size", F.col("p_size") + 1).alias("t"), F.array(F.col("p_retailprice"), F.lit(None)).alias("close")))
    read = table(spark, sf_dir, "part").select("p_partkey", F.from_json(payload, "t array<int>, close array<double>").alias("x"))
    rows = read.select("p_partkey", F.explode(F.arrays_zip("x.t", "x.close")).alias("z"))
    return rows.select("p_partkey", "z.t", "z.close").filter(F.col("close").isNotNull())


@query("src_17_feed_items", "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, timestamp '2023-11-14 22:13:20' + to_hours(page_id) as published from pages where url is not null and regexp_extract(html, '<title>([^<]*)</title>', 1) <> ''")
def src_17_feed_items(spark, sf_dir):
    """Items with a title and a link; epoch seconds become timestamps."""
    items = table(spark, sf_dir, "pages").filter("url is not null").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.timestamp_seconds(F.lit(1_700_000_000) + 3600 * F.col("page_id")).alias("published"))
    return items.filter("title <> ''")


@query("src_23_stale_fundamentals", "select o_orderkey, date_diff('day', cast(o_orderdate as date), date '1998-06-15') > 3 as refused, least(0.85, 0.25 + 0.06*(cast(o_orderstatus is not null as int) + cast(o_totalprice > 100000 as int) + cast(o_orderpriority is not null as int))) as confidence from orders where cast(o_orderdate as date) <= date '1998-06-15'")
def src_23_stale_fundamentals(spark, sf_dir):
    """Facts older than three days are refused; confidence grows with the fields that are there."""
    ref, day = F.lit("1998-06-15").cast("date"), F.to_date("o_orderdate")
    large = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))
    fields = sum((c.isNotNull().cast("int") for c in (F.col("o_orderstatus"), large, F.col("o_orderpriority"))), F.lit(0))
    return table(spark, sf_dir, "orders").filter(day <= ref).select("o_orderkey", (F.datediff(ref, day) > 3).alias("refused"), F.least(F.lit(0.85), 0.25 + 0.06 * fields).alias("confidence"))


@query("flt_07_earnings_split", "(select 'upcoming' as bucket, o_orderkey from orders where cast(o_orderdate as date) >= date '1998-01-01' order by o_orderdate, o_orderkey limit 100) union all (select 'recent' as bucket, o_orderkey from orders where cast(o_orderdate as date) < date '1998-01-01' and o_totalprice is not null order by o_orderdate desc, o_orderkey limit 50)")
def flt_07_earnings_split(spark, sf_dir):
    """The 100 next and the 50 latest with figures; the limits are the feature."""
    orders, ref = table(spark, sf_dir, "orders"), F.lit("1998-01-01").cast("date")
    coming = orders.filter(F.to_date("o_orderdate") >= ref).orderBy("o_orderdate", "o_orderkey").limit(100).select(F.lit("upcoming").alias("bucket"), "o_orderkey")
    recent = orders.filter((F.to_date("o_orderdate") < ref) & F.col("o_totalprice").isNotNull()).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    return coming.unionByName(recent.select(F.lit("recent").alias("bucket"), "o_orderkey"))


@query("flt_08_symbol_search", "select p_brand as symbol, min(p_partkey) as first_part from part where lower(p_brand) like '%1%' and p_type is not null group by 1 order by 1 limit 12")
def flt_08_symbol_search(spark, sf_dir):
    """One row a symbol, the first twelve by name."""
    hits = table(spark, sf_dir, "part").filter(F.lower("p_brand").contains("1") & F.col("p_type").isNotNull())
    return hits.groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_partkey").alias("first_part")).orderBy("symbol").limit(12)


@query("flt_11_lookahead", "select event_id, case when cast(ts as date) > date '2024-01-15' then 'error' else 'ok' end as status from events")
def flt_11_lookahead(spark, sf_dir):
    """A result that knows more than its cut-off date is an error."""
    late = F.to_date("ts") > F.lit("2024-01-15").cast("date")
    return table(spark, sf_dir, "events").select("event_id", F.when(late, "error").otherwise("ok").alias("status"))


@query("flt_13_adjusted_mismatch", f"with {INDEXED_SQL.strip()} select symbol, date from ix where abs(close-open)/close > 0.005")
def flt_13_adjusted_mismatch(spark, sf_dir):
    """Bars whose second price strays more than half a percent; open stands for the adjusted close."""
    return indexed(spark, sf_dir).filter(F.abs(F.col("close") - F.col("open")) / F.col("close") > 0.005).select("symbol", "date")


@query("flt_17_validation", "select c_custkey, case when c_acctbal < 100 then 10000.0 else c_acctbal end as budget, regexp_matches(c_mktsegment, '^[A-Z]{1,9}$') as valid from customer")
def flt_17_validation(spark, sf_dir):
    """Budgets below 100 become 10 000; codes are checked by pattern."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 100, 10000.0).otherwise(F.col("c_acctbal")).alias("budget"), F.col("c_mktsegment").rlike("^[A-Z]{1,9}$").alias("valid"))


_LESSONS = "lessons as (select user_id, case when user_id % 7 = 0 then 'global' else event_type end as scope, min(cast(ts as date)) as learned_on, count(*) as seen from events group by 1, 2)"
_ASKED = "asked as (select scope, as_of from (select distinct event_type as scope from events) cross join (select unnest([date '2024-01-05', date '2024-01-20']) as as_of))"


@query("join_07_lessons", f"with {_LESSONS}, {_ASKED}, m as (select a.scope, a.as_of, l.user_id, l.seen, row_number() over (partition by a.scope, a.as_of order by l.seen desc, l.user_id, l.scope) as place from asked a join lessons l on l.scope in (a.scope, 'global') and l.learned_on < a.as_of) select scope, as_of, place, user_id, seen from m where place <= 3")
def join_07_lessons(spark, sf_dir):
    """The three commonest lessons known before a date, of a scope or global: an equi join on either scope."""
    events = table(spark, sf_dir, "events")
    lessons = events.groupBy("user_id", F.when(F.col("user_id") % 7 == 0, "global").otherwise(F.col("event_type")).alias("kind")).agg(F.min(F.to_date("ts")).alias("learned_on"), F.count("*").alias("seen"))
    dates = F.array(*[F.lit(d).cast("date") for d in ("2024-01-05", "2024-01-20")])
    asked = events.select(F.col("event_type").alias("scope")).distinct().select("scope", F.explode(dates).alias("as_of"))
    asked = asked.select("scope", "as_of", F.explode(F.array_distinct(F.array("scope", F.lit("global")))).alias("kind"))
    best = Window.partitionBy("scope", "as_of").orderBy(F.desc("seen"), "user_id", "kind")
    known = lessons.join(asked, "kind").filter("learned_on < as_of")
    return known.withColumn("place", F.row_number().over(best)).filter("place <= 3").select("scope", "as_of", "place", "user_id", "seen")


@query("join_07_lessons_each_day", f"with {_LESSONS}, asked as (select distinct event_type as scope, cast(ts as date) as as_of from events), m as (select a.scope, a.as_of, l.user_id, l.seen, row_number() over (partition by a.scope, a.as_of order by l.seen desc, l.user_id, l.scope) as place from asked a join lessons l on l.scope in (a.scope, 'global') and l.learned_on < a.as_of) select scope, as_of, place, user_id, seen from m where place <= 3")
def join_07_lessons_each_day(spark, sf_dir):
    """The same on every day that a scope has events: only the best three of a kind's day can be among the best of all days before another."""
    events = table(spark, sf_dir, "events")
    lessons = events.groupBy("user_id", F.when(F.col("user_id") % 7 == 0, "global").otherwise(F.col("event_type")).alias("kind")).agg(F.min(F.to_date("ts")).alias("learned_on"), F.count("*").alias("seen"))
    daily = Window.partitionBy("kind", "learned_on").orderBy(F.desc("seen"), "user_id")
    lessons = lessons.withColumn("_place", F.row_number().over(daily)).filter("_place <= 3").drop("_place")
    asked = events.select(F.col("event_type").alias("scope"), F.to_date("ts").alias("as_of")).distinct().select("scope", "as_of", F.explode(F.array_distinct(F.array("scope", F.lit("global")))).alias("kind"))
    best = Window.partitionBy("scope", "as_of").orderBy(F.desc("seen"), "user_id", "kind")
    known = lessons.join(asked, "kind").filter("learned_on < as_of")
    return known.withColumn("place", F.row_number().over(best)).filter("place <= 3").select("scope", "as_of", "place", "user_id", "seen")


_FIRST = "(select l_orderkey as decision_id, arg_min(l_extendedprice, (l_linenumber, l_partkey, l_extendedprice)) as exit_price from lineitem group by 1)"


@query("snk_02_new_outcomes", f"select * from {_FIRST}")
def snk_02_new_outcomes(spark, sf_dir):
    """One outcome a decision: those of finished orders are stored first, and none of them is written again."""
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))["l_extendedprice"]
    outcomes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("decision_id")).agg(first.alias("exit_price"))
    finished = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("decision_id"))
    store = shared.Store(spark, shared.folder(spark), outcomes.schema, ["decision_id"])
    store.append(outcomes.join(finished, "decision_id", "left_semi"))
    store.append(outcomes)
    return store.read()


@query("snk_05_universe_hash", "select count(*) as n, sha256(string_agg(symbol, ',' order by symbol)) as hash from (select distinct p_brand as symbol from part)")
def snk_05_universe_hash(spark, sf_dir):
    """The frozen universe's fingerprint; the symbol dimension bounds the list."""
    names = F.array_sort(F.collect_set("p_brand"))
    return table(spark, sf_dir, "part").agg(F.size(names).cast("long").alias("n"), F.sha2(F.array_join(names, ","), 256).alias("hash"))


@query("snk_07_field_update", """select event_id, cast(json_extract_string(props, '$.k') as int) as k, event_type = 'click' as is_read from events where user_id % 10 <> 3""")
def snk_07_field_update(spark, sf_dir):
    """A field set inside a nested value, and a keyed delete."""
    note = F.from_json("props", "k int").withField("read", F.col("event_type") == "click")
    return table(spark, sf_dir, "events").filter("user_id % 10 <> 3").select("event_id", note.alias("note")).select("event_id", "note.k", F.col("note.read").alias("is_read"))


_FEED = "fd as (select page_id, array_to_string(list_transform(range(1, 26), lambda i: '<item><title><![CDATA[Story ' || i || ' &amp; page ' || page_id || ' - late - Wire' || (i%3) || ']]></title><link>' || url || '</link></item>'), '') as feed from pages), it as (select page_id, unnest(regexp_extract_all(feed, '<title><!.CDATA.(.*?)..></title>', 1)[1:20]) as raw, unnest(range(1, 21)) as place from fd)"


@query("src_16_feed_items", f"with {_FEED}, sp as (select page_id, place, string_split(replace(raw, '&amp;', '&'), ' - ') as parts from it) select page_id, cast(place as int) as place, array_to_string(parts[1:len(parts)-1], ' - ') as title, parts[len(parts)] as source from sp")
def src_16_feed_items(spark, sf_dir):
    """The first 20 items of a feed: CDATA, entities, and the source after the last dash."""
    item = lambda i: F.concat(F.lit("<item><title><![CDATA[Story "), i.cast("string"), F.lit(" &amp; page "), F.col("page_id").cast("string"), F.lit(" - late - Wire"), (i % 3).cast("string"), F.lit("]]></title><link>"), F.col("url"), F.lit("</link></item>"))
    feeds = table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(25)), item), "").alias("feed"))
    titles = F.slice(F.regexp_extract_all("feed", F.lit(r"<title><!\[CDATA\[(.*?)\]\]></title>"), 1), 1, 20)
    x = feeds.select("page_id", F.posexplode(titles).alias("at", "raw")).withColumn("parts", F.split(F.replace("raw", F.lit("&amp;"), F.lit("&")), " - "))
    title = F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), " - ")
    return x.select("page_id", (F.col("at") + 1).alias("place"), title.alias("title"), F.element_at("parts", -1).alias("source"))
