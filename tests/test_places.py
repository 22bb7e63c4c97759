"""Places, caps and the curation of lessons against plain sorting."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.operators.places import curated, with_cap, with_place
from tidemark.plans import registry


@pytest.mark.parametrize("hot", [0.0, 0.6, 1.0])
def test_places_equal_a_full_sort(spark, hot):
    """Ties, one value that most rows share, nulls in every key."""
    draw = random.Random(int(hot * 10))
    rows = [(7.0 if draw.random() < hot else draw.choice([None, draw.random(), 0.5]), draw.choice(["a", "b", None, "c"]), k) for k in range(700)]
    got = with_place(spark.createDataFrame(rows, "v double, w string, k long"), "v", "w", ["k"], bands=8).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0.0), r[1] is not None, r[1] or "", r[2]))
    assert [(r["v"], r["w"], r["k"]) for r in sorted(got, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got) == list(range(1, 701))


def test_places_of_no_rows_and_of_nulls(spark):
    none = spark.createDataFrame([], "v double, w string")
    assert with_place(none, "v", "w", []).count() == 0
    only = spark.createDataFrame([(None, "x"), (None, None)], "v double, w string")
    assert [(r["w"], r["place"]) for r in with_place(only, "v", "w", []).orderBy("place").collect()] == [(None, 1), ("x", 2)]


def test_cap_keeps_the_first(spark):
    rows = [(k, k % 5, "old") for k in range(50)]
    got = with_cap(spark.createDataFrame(rows, "k long, v long, kept string"), ["k"], [F.desc("v"), F.col("k")], 7).collect()
    want = {r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))[:7]}
    assert len(got) == 50 and {r["k"] for r in got if r["kept"]} == want


@pytest.mark.parametrize("stale_days", [9, 90])
def test_lessons(spark, stale_days):
    draw, today = random.Random(3), datetime.date(2024, 2, 20)
    rows = [(k, draw.randrange(1, 7), today - datetime.timedelta(days=draw.randrange(420))) for k in range(120)]
    frame = spark.createDataFrame(rows, "k long, times_seen long, last_seen date")
    got = {r["k"]: r["status"] for r in curated(frame, ["k"], F.lit(today), stale_days, 20).collect()}
    live = [r for r in rows if (today - r[2]).days <= stale_days * min(4, r[1])]
    kept = {r[0] for r in sorted(live, key=lambda r: (-r[1], -r[2].toordinal(), r[0]))[:20]}
    assert got == {r[0]: "active" if r[0] in kept else "over cap" if r in live else "stale" for r in rows}


def test_no_evidence_means_hold(spark):
    """Without news and forecast there is no score: the action is hold, the verdict says why, nothing is bought."""
    x = registry.queries()["dec_05_recommendation"](spark, SMALL).toPandas()
    blind = x[x["sources"] == 0]
    assert len(blind) and set(blind["action"]) == {"hold"} and set(blind["verdict"]) == {"insufficient_data"} and blind["score"].isna().all() and (blind["amount"] == 0).all()
    rest = x[x["sources"] > 0]
    assert rest["score"].notna().all() and set(zip(rest["action"], rest["verdict"])) <= {("buy", "buy_now"), ("sell", "avoid"), ("hold", "wait")}
