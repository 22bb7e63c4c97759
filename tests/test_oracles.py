"""Every query with SQL agrees with DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from tests.conftest import SMALL
from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SMALL}/{name}.parquet')")
    return con


def cell(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and isinstance(v.tolist(), list):
        return str([cell(x) for x in v])
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)


def rows(frame):
    return sorted(map(tuple, frame[sorted(frame.columns)].map(cell).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees(spark, duck, name):
    ours, theirs = registry.queries()[name](spark, SMALL).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
