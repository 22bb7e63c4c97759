"""Queries over text: sentiment, tokens, feeds, requests, dedupe of articles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.lexicon import BEAR, BULL, FIXTURE, SENTIMENT, SIGNS
from tidemark.functions.numeric import rounded
from tidemark.operators import sentiment
from tidemark.plans.registry import query
from tidemark.plans.technical import r6
from tidemark.sources.market import table

_TOKENS = "tk as (select doc_id, source, list_distinct(list_transform(string_split_regex(lower(text), '[\\s]+'), lambda w: trim(w, '.,;:!?'))) as tokens from documents)"
_W = "case w " + " ".join(f"when '{k}' then {v}" for k, v in FIXTURE.items()) + " else 0 end"
_HITS = f"ht as (select doc_id, source, list_sum(list_transform(tokens, lambda w: {_W})) as score, len(list_filter(tokens, lambda w: {_W}<>0)) as hits from tk)"
_LEVEL = "case when hits=0 then 'HOLD' when score*1.0/hits>=1.2 then 'STRONG_BUY' when score*1.0/hits>0.2 then 'BUY' when score*1.0/hits<=-1.2 then 'STRONG_SELL' when score*1.0/hits<-0.2 then 'SELL' else 'HOLD' end"


def labelled(spark, sf_dir):
    tokens = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.btrim(w, F.lit(".,;:!?"))))
    weights = F.create_map(*[F.lit(x) for pair in FIXTURE.items() for x in pair])
    found = F.filter(F.transform(tokens, lambda w: F.try_element_at(weights, w)), lambda w: w.isNotNull())
    x = table(spark, sf_dir, "documents").select("doc_id", "source", found.alias("found"))
    x = x.select("doc_id", "source", F.aggregate("found", F.lit(0), lambda a, w: a + w).alias("score"), F.size("found").alias("hits"))
    mean = F.col("score") / F.greatest("hits", F.lit(1))
    level = F.when(F.col("hits") == 0, "HOLD").when(mean >= 1.2, "STRONG_BUY").when(mean > 0.2, "BUY").when(mean <= -1.2, "STRONG_SELL").when(mean < -0.2, "SELL").otherwise("HOLD")
    return x.withColumn("level", level)


@query("str_01_sentiment_label", f"with {_TOKENS}, {_HITS} select doc_id, cast(score as int) as score, cast(hits as int) as hits, {_LEVEL} as level from ht")
def str_01_sentiment_label(spark, sf_dir):
    """Each distinct token counts once."""
    return labelled(spark, sf_dir).select("doc_id", "score", "hits", "level")


@query("agg_36_sentiment_by_source", f"with {_TOKENS}, {_HITS}, lv as (select *, {_LEVEL} as level from ht) select source, count(*) as n, {r6('sum(score)*1.0/greatest(sum(hits),1)')} as weighted, count(*) filter (level like '%BUY') as bullish, count(*) filter (level like '%SELL') as bearish from lv group by source")
def agg_36_sentiment_by_source(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("n"), rounded(F.sum("score") / F.greatest(F.sum("hits"), F.lit(1))).alias("weighted"), F.count_if(F.col("level").endswith("BUY")).alias("bullish"), F.count_if(F.col("level").endswith("SELL")).alias("bearish"))


@query("flt_04_sentiment_shares", f"with {_TOKENS}, {_HITS}, lv as (select *, {_LEVEL} as level from ht) select level, {r6('count(*)*100.0/sum(count(*)) over ()')} as share from lv group by level")
def flt_04_sentiment_shares(spark, sf_dir):
    g = labelled(spark, sf_dir).groupBy("level").agg(F.count("*").alias("c"))
    return g.select("level", rounded(F.col("c") * 100.0 / F.sum("c").over(Window.partitionBy(F.lit(0)))).alias("share"))  # five rows


@query("add_06_three_classes", f"with {_TOKENS}, {_HITS}, lv as (select *, {_LEVEL} as level from ht) select doc_id, case when level like '%BUY' then 'positive' when level like '%SELL' then 'negative' else 'neutral' end as class from lv")
def add_06_three_classes(spark, sf_dir):
    level = F.col("level")
    return labelled(spark, sf_dir).select("doc_id", F.when(level.endswith("BUY"), "positive").when(level.endswith("SELL"), "negative").otherwise("neutral").alias("class"))


@query("agg_34_confusion", f"with {_TOKENS}, {_HITS}, c as (select case when score>0 then 1 else 0 end as p, quality as y from ht join labels using (doc_id)), k as (select unnest([0,1]) as class) select class, count(*) filter (p=class and y=class) as tp, count(*) filter (p=class and y<>class) as fp, count(*) filter (p<>class and y=class) as fn, {r6('count(*) filter (p=class and y=class)*1.0/greatest(count(*) filter (p=class),1)')} as precision, {r6('count(*) filter (p=class and y=class)*1.0/greatest(count(*) filter (y=class),1)')} as recall from c cross join k group by class")
def agg_34_confusion(spark, sf_dir):
    c = labelled(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select(F.when(F.col("score") > 0, 1).otherwise(0).alias("p"), F.col("quality").alias("y"), F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))
    p, y = F.col("p") == F.col("class"), F.col("y") == F.col("class")
    tp = F.count_if(p & y)
    return c.groupBy("class").agg(tp.alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), rounded(tp / F.greatest(F.count_if(p), F.lit(1))).alias("precision"), rounded(tp / F.greatest(F.count_if(y), F.lit(1))).alias("recall"))


def _contains(words, column):
    return "(" + "+".join(f"(contains(lower({column}), '{w}'))::int" for w in words) + ")"


@query("str_02_substring_sentiment", f"select doc_id, {_contains(BULL, 'text')} as bull, {_contains(BEAR, 'text')} as bear, case when {_contains(BULL, 'text')}>{_contains(BEAR, 'text')} then 'bullish' when {_contains(BULL, 'text')}<{_contains(BEAR, 'text')} then 'bearish' else 'neutral' end as tone from documents")
def str_02_substring_sentiment(spark, sf_dir):
    """Substring hits: "bull" counts inside longer words."""
    count = lambda words: sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in words), F.lit(0))
    x = table(spark, sf_dir, "documents").select("doc_id", count(BULL).alias("bull"), count(BEAR).alias("bear"))
    return x.withColumn("tone", F.when(F.col("bull") > F.col("bear"), "bullish").when(F.col("bull") < F.col("bear"), "bearish").otherwise("neutral"))


_STOP = ("the", "and", "for", "that", "with")
_STOPS = ", ".join(f"'{w}'" for w in _STOP)


@query("str_03_tokens", f"select doc_id, len(list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g')), ' +'), lambda w: len(w)>2 and w not in ({_STOPS}))) as n_tokens from documents")
def str_03_tokens(spark, sf_dir):
    words = F.split(F.lower(F.regexp_replace("text", "[^A-Za-z0-9 ]", " ")), " +")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*_STOP))).cast("long").alias("n_tokens"))


@query("str_04_relevance", "with q as (select ['the','that','reed'] as ask) select doc_id, " + r6("least(greatest(len(list_filter(string_split_regex(lower(text), '[\\s]+'), lambda w: list_contains(ask, w)))*0.72/3, 0.12), 0.98)") + " as relevance from documents, q")
def str_04_relevance(spark, sf_dir):
    ask = F.array(*map(F.lit, ("the", "that", "reed")))
    hits = F.size(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.array_contains(ask, w)))
    return table(spark, sf_dir, "documents").select("doc_id", rounded(F.least(F.greatest(hits * 0.72 / 3, F.lit(0.12)), F.lit(0.98))).alias("relevance"))


@query("set_02_lexicon_overlap", "select doc_id, len(list_intersect(list_distinct(string_split_regex(lower(text), '[\\s]+')), ['the','and','of','to'])) as overlap from documents")
def set_02_lexicon_overlap(spark, sf_dir):
    both = F.array_intersect(F.array_distinct(F.split(F.lower("text"), r"\s+")), F.array(*map(F.lit, ("the", "and", "of", "to"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(both).cast("long").alias("overlap"))


@query("set_03_dedupe_articles", "select doc_id, source from documents qualify row_number() over (partition by lower(text) order by doc_id)=1")
def set_03_dedupe_articles(spark, sf_dir):
    """First article of each text, found on a digest so the texts themselves are not shuffled."""
    first = table(spark, sf_dir, "documents").groupBy(F.sha2(F.lower("text"), 256).alias("digest")).agg(F.min(F.struct("doc_id", "source")).alias("first"))
    return first.select("first.doc_id", "first.source")


@query("flt_09_keyword_filter", "select doc_id from documents where regexp_matches(text, '(?i)license|rights') and not regexp_matches(text, '(?i)apache')")
def flt_09_keyword_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike("(?i)license|rights") & ~F.col("text").rlike("(?i)apache")).select("doc_id")


@query("src_16_page_titles", "select page_id, replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as title from pages")
def src_16_page_titles(spark, sf_dir):
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    for entity, text in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        title = F.replace(title, F.lit(entity), F.lit(text))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"))


@query("src_16_page_links", "select page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as links from pages")
def src_16_page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).cast("long").alias("links"))


@query("str_15_stable_key", "select doc_id, substr(sha256(lang || '|' || source || '|' || doc_id), 1, 16) as key from documents")
def str_15_stable_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.concat_ws("|", "lang", "source", F.col("doc_id").cast("string")), 256), 1, 16).alias("key"))


@query("agg_37_recency_polarity", f"with {_TOKENS}, {_HITS} select source, {r6('sum(score*power(0.5,(doc_id%240)/72.0))/sum(power(0.5,(doc_id%240)/72.0))')} as polarity from ht group by source")
def agg_37_recency_polarity(spark, sf_dir):
    weight = F.pow(F.lit(0.5), (F.col("doc_id") % 240) / 72.0)
    return labelled(spark, sf_dir).groupBy("source").agg(rounded(F.sum(F.col("score") * weight) / F.sum(weight)).alias("polarity"))


# --- Sentiment by the true lists, and by lists given as a parameter ----------
def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words)) + "]"


def _label_sql(table_name: str, columns: str, lists) -> str:
    found = [f"len(list_intersect(tokens, {_quoted(words)}))" for _, words in lists]
    total = " + ".join(f"{n}*({w}.0)" for n, (w, _) in zip(found, lists, strict=True))
    return f"""tk as (select {columns}, list_distinct(list_transform(string_split_regex(coalesce(text, ''), '\\s+'), lambda t: lower(trim(t, '{SIGNS.replace("'", "''")}')))) as tokens from {table_name}),
sc as (select {columns}, {" + ".join(found)} as hits, {total} as total from tk),
lb as (select {columns}, cast(hits as int) as hits, case when hits>0 then total/hits else 0.0 end as score from sc),
ll as (select *, case when score>=1.5 then 'STRONG_BUY' when score>=0.5 then 'BUY' when score>=-0.5 then 'HOLD' when score>=-1.5 then 'SELL' else 'STRONG_SELL' end as level from lb)"""


#: The invented prose holds no word of the true lists, so the rules over many labels also run on lists of its own syllables.
SYLLABLES = tuple((w, [k for k, v in FIXTURE.items() if v == w]) for w in (2, 1, -1, -2))


@query("str_01_document_level", f"with {_label_sql('documents', 'doc_id', SENTIMENT)} select doc_id, hits, {r6('score')} as score, level from ll")
def str_01_document_level(spark, sf_dir):
    """Level of each whole document by the true lists."""
    return sentiment.labelled(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "hits", rounded(F.col("score")).alias("score"), "level")


@query("str_01_turn_level", f"with {_label_sql('conversations', 'conv_id, turn, role', SENTIMENT)} select conv_id, turn, role, hits, {r6('score')} as score, level from ll")
def str_01_turn_level(spark, sf_dir):
    """Level of each turn of a conversation by the true lists."""
    return sentiment.labelled(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "hits", rounded(F.col("score")).alias("score"), "level")


@query("agg_36_consensus", f"""with {_label_sql('documents', 'doc_id, source, n_chars', SYLLABLES)},
w as (select source, level, greatest(least(n_chars/2000.0, 1.0), 0.05) as weight, case level when 'STRONG_BUY' then 2.0 when 'BUY' then 1.0 when 'HOLD' then 0.0 when 'SELL' then -1.0 else -2.0 end as value from ll),
g as (select source, count(*) as n, count(*) filter (level='STRONG_BUY') as strong_buy, count(*) filter (level='BUY') as buy, count(*) filter (level='HOLD') as hold, count(*) filter (level='SELL') as sell, count(*) filter (level='STRONG_SELL') as strong_sell, sum(value*weight)/sum(weight) as mean, max(weight)/sum(weight) as heavy from w group by source)
select source, n, strong_buy, buy, hold, sell, strong_sell, floor(mean*1000+0.5)/1000 as score, case when mean>=1.5 then 'STRONG_BUY' when mean>=0.5 then 'BUY' when mean>=-0.5 then 'HOLD' when mean>=-1.5 then 'SELL' else 'STRONG_SELL' end as level,
  floor(least(0.95, 0.45+abs(mean)*0.28+greatest(strong_buy, buy, hold, sell, strong_sell)*0.2/n+heavy*0.18)*1000+0.5)/1000 as confidence from g""")
def agg_36_consensus(spark, sf_dir):
    """Score, level and confidence of each source's documents together, longer ones weighing more up to 2000 characters."""
    x = sentiment.labelled(table(spark, sf_dir, "documents").select("source", "text", "n_chars"), lists=SYLLABLES)
    return sentiment.consensus(x, ["source"], F.least(F.col("n_chars") / 2000.0, F.lit(1.0)))
