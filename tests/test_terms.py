"""Term lists found by one automaton, against substring search."""

from __future__ import annotations

import random

import pytest

from tidemark.functions.lexicon import FLAGS
from tidemark.operators.terms import first_of, flagged
from tidemark.plans import turns as turns_plan


def test_hits_equal_substring_search(spark):
    draw = random.Random(5)
    words = [t for terms in FLAGS.values() for t in terms] + ["said", "wars", "x", "éa", "trade  war", "seconds"]
    rows = [(k, draw.choice(["", " ", "-"]).join(draw.choice(words) for _ in range(draw.randrange(12)))) for k in range(200)]
    rows = [(k, t.upper() if k % 3 else t) for k, t in rows]
    got = {r["id"]: r for r in flagged(spark.createDataFrame(rows, "id long, text string"), FLAGS, count="terms").collect()}
    for k, text in rows:
        low = text.lower()
        assert {f for f in FLAGS if got[k][f]} == {f for f, terms in FLAGS.items() if any(t in low for t in terms)}
        assert got[k]["terms"] == len({t for terms in FLAGS.values() for t in terms if t in low})


def test_overlaps_nested_terms_and_shared_terms(spark):
    """A term inside another, one that overlaps the next, and one of two lists all count."""
    lists = {"a": ("he", "hers"), "b": ("she", "hers"), "c": ("rs x",), "none": (), "blank": ("",)}
    rows = [(0, "ushers xx"), (1, None), (2, ""), (3, "SHE"), (4, "h e")]
    got = flagged(spark.createDataFrame(rows, "id long, text string"), lists, count="n").orderBy("id").collect()
    assert [[r[c] for c in ("a", "b", "c", "none", "blank", "n")] for r in got] == [[True, True, True, False, False, 4], *[[False] * 5 + [0]] * 2, [True, True, False, False, False, 2], [False] * 5 + [0]]


def test_clashing_columns_long_texts_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "x" * 3_000_000 + "gold", "old"), (1, "gold", "old")], "id long, text string, a string")
    got = flagged(frame, {"a": ("gold",)})
    assert got.columns == ["id", "text", "a"] and [r["a"] for r in got.collect()] == [True, True]
    assert flagged(frame.limit(0), {"a": ("gold",)}).count() == 0
    assert [r["n"] for r in flagged(frame, {}, count="n").collect()] == [0, 0]
    with pytest.raises(ValueError):
        flagged(frame, {"text": ("gold",)})


def test_first_flag_wins(spark):
    x = spark.createDataFrame([(True, True), (False, True), (False, False)], "p boolean, q boolean")
    assert [r[0] for r in x.select(first_of([("p", 1), ("q", 2)], 9)).collect()] == [1, 2, 9]


def test_ticker_of_a_turn(spark, tmp_path):
    """Signs before names before words; stop words, long words and bounds."""
    turns = ["Should I buy $amd now", "is Apple fine", "Sell the XYZ-1 stock", "IS IT THE", "12 ab_c Straße", None, "$ " + "q" * 16 + " ok", "é$T. x"]
    spark.createDataFrame([(0, k, t) for k, t in enumerate(turns)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = turns_plan.str_09_turn_ticker(spark, str(tmp_path)).orderBy("turn").collect()
    want = [("AMD", "sign"), ("AAPL", "name"), ("XYZ-1", "word"), ("", "none"), ("STRASSE", "word"), ("", "none"), ("OK", "word"), ("T", "sign")]
    assert [(r["ticker"], r["origin"]) for r in got] == want
