"""What the texts themselves ask: flags, horizon, asset, bias and ticker of whole turns and articles.

Spark steps one automaton over each text; the SQL searches every term on its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.lexicon import ASSET_TERMS, BIAS, FLAGS, GOALS, HORIZONS
from tidemark.functions.numeric import rounded
from tidemark.operators.terms import first_of, flagged
from tidemark.plans.registry import query
from tidemark.plans.technical import r6
from tidemark.sources.market import table

_FLAGS = {f"f_{name}": terms for name, terms in FLAGS.items()}
_HORIZON = {f"h_{days}": terms for terms, days, _ in HORIZONS}
_ASSET = {f"a_{name}": terms for name, terms in ASSET_TERMS}
_GOAL = {f"g_{name}": terms for name, terms in GOALS}
#: Words of a question that are no ticker.
STOPS = tuple("SHOULD BUY SELL HOLD THIS STOCK WEEK MONTH YEAR NOW FOR THE AND OR IS IT A AN OF TO".split())
#: Companies by the names that questions use.
COMPANIES = {
    "apple": "AAPL", "microsoft": "MSFT", "google": "GOOGL", "alphabet": "GOOGL", "amazon": "AMZN", "tesla": "TSLA", "nvidia": "NVDA", "meta": "META", "netflix": "NFLX",
    "visa": "V", "mastercard": "MA", "jpmorgan": "JPM", "walmart": "WMT", "infosys": "INFY.NS", "reliance": "RELIANCE.NS",
}
_NAME = {f"n_{name}": (name,) for name in COMPANIES}
#: A word of letters, digits, dots and dashes, of 15 at most, between bounds of ASCII words.
_WORD = r"[A-Z][A-Z0-9.-]{0,14}"
_BOUND = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _has(terms) -> str:
    return "(" + " or ".join("contains(low, '" + t.replace("'", "''") + "')" for t in terms) + ")"


def _case(cases, default) -> str:
    return "case " + " ".join(f"when {_has(terms)} then {value}" for terms, value in cases) + f" else {default} end"


def _sql(key: str, source: str, columns: str) -> str:
    return f"with t as (select {key}, lower(coalesce(text, '')) as low, coalesce(text, '') as text from {source}) select {key}, {columns} from t"


_TERMS = sorted({t for terms in FLAGS.values() for t in terms})
_FLAG_SQL = ", ".join(f"{_has(terms)} as {name}" for name, terms in _FLAGS.items()) + ", cast(" + "+".join(f"contains(low, '{t}')::int" for t in _TERMS) + " as int) as terms"


def _flags(df, key):
    return flagged(df.select(*key, "text"), _FLAGS, count="terms").drop("text")


@query("str_06_turn_flags", _sql("conv_id, turn", "conversations", _FLAG_SQL))
def str_06_turn_flags(spark, sf_dir):
    """Which of the 22 flags a turn of a conversation raises, and how many of their terms it holds."""
    return _flags(table(spark, sf_dir, "conversations"), ("conv_id", "turn"))


@query("str_06_article_flags", _sql("doc_id", "documents", _FLAG_SQL))
def str_06_article_flags(spark, sf_dir):
    """The same of whole articles."""
    return _flags(table(spark, sf_dir, "documents"), ("doc_id",))


_ASSET_CASE = _case([(terms, f"'{name}'") for name, terms in ASSET_TERMS], "'equity'")
_BIAS_SQL = "cast(case asset " + " ".join(f"when '{a}' then " + "+".join(f"case when {_has(FLAGS[f])} then {w} else 0 end" for f, w in weights.items() if f in FLAGS) for a, weights in BIAS.items()) + " end as double)"
_DAYS_CASE = _case([(terms, days) for terms, days, _ in HORIZONS], 5)
_LABEL_CASE = _case([(terms, f"'{label}'") for terms, _, label in HORIZONS], "'5 trading days'")
_GOAL_CASE = _case([(terms, f"'{name}'") for name, terms in GOALS], "'investment'")


@query("str_07_turn_profile", f"with t as (select conv_id, turn, lower(coalesce(text, '')) as low from conversations), a as (select *, {_ASSET_CASE} as asset from t) select conv_id, turn, cast({_DAYS_CASE} as int) as horizon_days, {_LABEL_CASE} as horizon, asset, {_GOAL_CASE} as goal, {r6(_BIAS_SQL)} as bias from a")
def str_07_turn_profile(spark, sf_dir):
    """Horizon, asset class, goal and the bias that the flags raised give to the asset, of each turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    x = flagged(turns, _FLAGS | _HORIZON | _ASSET | _GOAL).drop("text")
    x = x.withColumn("asset", first_of([(f"a_{name}", name) for name, _ in ASSET_TERMS], "equity"))
    bias = F.lit(0.0)
    for asset, weights in BIAS.items():
        raised = sum((F.when(F.col(f"f_{f}"), float(w)).otherwise(0.0) for f, w in weights.items() if f in FLAGS), F.lit(0.0))
        bias = F.when(F.col("asset") == asset, raised).otherwise(bias)
    days, label = ([(f"h_{d}", value) for _, d, _ in HORIZONS for value in [pick[d]]] for pick in ({d: d for _, d, _ in HORIZONS}, {d: n for _, d, n in HORIZONS}))
    return x.select("conv_id", "turn", first_of(days, 5).cast("int").alias("horizon_days"), first_of(label, "5 trading days").alias("horizon"), "asset", first_of([(f"g_{n}", n) for n, _ in GOALS], "investment").alias("goal"), rounded(bias).alias("bias"))


_NAMED = _case([((name,), f"'{symbol}'") for name, symbol in COMPANIES.items()], "''")
_STOPS = ", ".join(f"'{w}'" for w in STOPS)


@query("str_09_turn_ticker", f"""with t as (select conv_id, turn, lower(coalesce(text, '')) as low, upper(replace(coalesce(text, ''), 'ß', 'ss')) as up from conversations),
s as (select *, regexp_extract(up, '[$]({_WORD})\\b', 1) as dollar, coalesce(list_filter(regexp_extract_all(up, '\\b{_WORD}\\b'), lambda w: w not in ({_STOPS}))[1], '') as word, {_NAMED} as named from t)
select conv_id, turn, case when dollar<>'' then dollar when named<>'' then named else word end as ticker, case when dollar<>'' then 'sign' when named<>'' then 'name' when word='' then 'none' else 'word' end as origin from s""")
def str_09_turn_ticker(spark, sf_dir):
    """A $symbol of the turn, else a company that it names, else its first word that is no stop word."""
    up = F.upper(F.coalesce("text", F.lit("")))
    words = F.filter(F.regexp_extract_all(up, F.lit(_BOUND + _WORD + _BOUND), F.lit(0)), lambda w: ~w.isin(*STOPS))
    x = flagged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), _NAME)
    x = x.select("conv_id", "turn", F.regexp_extract(up, f"[$]({_WORD}){_BOUND}", 1).alias("dollar"), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("word"), first_of([(f"n_{n}", s) for n, s in COMPANIES.items()], "").alias("named"))
    signed, named = F.col("dollar") != "", F.col("named") != ""
    return x.select(
        "conv_id", "turn", F.when(signed, F.col("dollar")).when(named, F.col("named")).otherwise(F.col("word")).alias("ticker"),
        F.when(signed, "sign").when(named, "name").when(F.col("word") == "", "none").otherwise("word").alias("origin"))


@query("agg_36_flags_by_source", f"with t as (select source, lower(coalesce(text, '')) as low from documents) select source, count(*) as n, {', '.join(f'count(case when {_has(terms)} then 1 end) as {name}' for name, terms in _FLAGS.items())} from t group by source")
def agg_36_flags_by_source(spark, sf_dir):
    """Articles of a source, and how many raise each flag."""
    x = flagged(table(spark, sf_dir, "documents").select("source", "text"), _FLAGS).drop("text")
    return x.groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(c) for c in _FLAGS])
