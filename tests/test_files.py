"""Vendor files: odd headers, encodings and broken lines."""

from __future__ import annotations

from tidemark.sources.files import json_lines, phrase_bank, vendor_csv


def test_vendor_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('DATE,Close/Last,Volume\nTicker,ABC,ABC\n07/15/2026,"$1,234.50","1,000"\n2026-07-14,12,\nbad,1,1\n2026-07-13,,5\n')
    rows = sorted((str(r.date), r.close, r.volume) for r in vendor_csv(spark, str(tmp_path / "p.csv")).collect())
    assert rows == [("2026-07-14", 12.0, None), ("2026-07-15", 1234.5, 1000.0)]


def test_phrase_bank(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes('positive,"Gains, at last"\rnegative,Café shut\r'.encode("latin-1"))
    assert sorted(map(tuple, phrase_bank(spark, str(tmp_path / "b.txt")).collect())) == [("negative", "Café shut"), ("positive", "Gains, at last")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2\n\n{"a": 3}\n')
    assert sorted(r.a for r in json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 3]
