"""Keyed streams, scoring and committed tables: restarts, replays, failed and late writers, clock changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.plans import streams
from tidemark.sources import shared
from tidemark.sources.commits import CommittedTable, Conflict
from tidemark.sources.market import changes, quotes
from tidemark.streaming import keyed
from tidemark.streaming.scoring import Scorer

TICKS = "symbol string, event_id long, ts timestamp, price double"


def drained(stream, path):
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def tick_rows(n: int, seed: int) -> list[tuple]:
    draw = np.random.default_rng(seed)
    start = pd.Timestamp("2024-03-01")
    minutes = np.sort(draw.integers(0, 60 * 24 * 9, n))
    return [("AB"[int(s)], i, (start + pd.Timedelta(minutes=int(m))).to_pydatetime(), float(np.round(p, 2))) for i, (m, s, p) in enumerate(zip(minutes, draw.integers(0, 2, n), draw.normal(100, 10, n), strict=True))]


def plain_alerts(ticks: list[tuple], alerts: list[tuple]) -> set[tuple]:
    fired, last, gone = set(), {}, set()
    for symbol, event, ts, price in sorted(ticks, key=lambda t: (t[2], t[1])):
        for alert, _, mine, direction, threshold, cadence in alerts:
            if mine != symbol or alert in gone or not (price >= threshold if direction == "above" else price <= threshold):
                continue
            if cadence == "daily" and alert in last and ts - last[alert] < pd.Timedelta(hours=20):
                continue
            last[alert] = ts
            fired.add((alert, event))
            if cadence == "once":
                gone.add(alert)
    return fired


def test_alerts_go_on_after_a_restart(spark):
    """Three drops, each taken by a query started anew from the checkpoint, equal one fold over all ticks."""
    ticks = tick_rows(400, 4)
    alerts = [(i, 100 + i, "AB"[i % 2], "above" if i % 3 else "below", 85.0 + 3 * i, "daily" if i % 4 else "once") for i in range(12)]
    known = spark.createDataFrame(alerts, "alert_id long, user_id long, symbol string, direction string, threshold double, cadence string")
    path = shared.folder(spark)
    for part in (ticks[:150], ticks[150:160], ticks[160:]):
        spark.createDataFrame(part, TICKS).coalesce(1).write.mode("append").parquet(f"{path}/ticks")
        drained(keyed.alert_stream(spark.readStream.schema(TICKS).parquet(f"{path}/ticks"), known, buckets=3), path)
    drained(keyed.alert_stream(spark.readStream.schema(TICKS).parquet(f"{path}/ticks"), known, buckets=3), path)
    got = spark.read.parquet(f"{path}/rows").collect()
    assert len(got) == len({(r.alert_id, r.event_id) for r in got})
    assert {(r.alert_id, r.event_id) for r in got} == plain_alerts(ticks, alerts)
    assert all(r.user_id == 100 + r.alert_id for r in got)


class Held(dict):
    """A map state in memory that counts its writes."""

    writes = 0

    def getMapState(self, *_):
        return self

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def removeKey(self, key):
        self.writes += 1
        del self[key]


def test_alerts_are_searched_and_kept_by_the_block():
    """1500 alerts are one block: read and written once a micro-batch, with the firings of one fold over all ticks."""
    ticks = [t for t in tick_rows(2000, 9) if t[0] == "A"]
    alerts = [(i, i, "A", "above" if i % 3 else "below", 60.0 + 0.05 * i, "daily" if i % 4 else "once") for i in range(1500)]
    state, machine, told = Held(), keyed.PriceAlerts(), set()
    machine.init(state)
    machine.handleInitialState(("A", 0), pd.DataFrame(alerts, columns=["alert_id", "user_id", "symbol", "direction", "threshold", "cadence"]), None)
    for part in (ticks[:400], ticks[400:]):
        frame = pd.DataFrame(part, columns=["symbol", "event_id", "ts", "price"]).sample(frac=1, random_state=1)
        frame["ts"] = frame["ts"].astype("datetime64[us]").astype("int64")
        packed = pd.concat([b.to_pandas() for b in keyed.packed(pa.RecordBatch.from_pandas(frame[k::3], preserve_index=False) for k in range(3))])
        told |= {(r.alert_id, r.event_id) for f in machine.handleInputRows(("A", 0), iter([packed]), None) for r in f.itertuples()}
    assert told == plain_alerts(ticks, alerts)
    assert state.writes == 3 and len(state) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 37])
def test_first_place_that_reaches_a_bound(n):
    draw = np.random.default_rng(n)
    values = draw.integers(0, 9, n).astype(float)
    start, bound = draw.integers(0, n + 1, 400), draw.integers(-1, 11, 400).astype(float)
    want = [next((i for i in range(s, n) if values[i] >= b), n) for s, b in zip(start, bound, strict=True)]
    assert keyed.Maxima(values).first(start, bound).tolist() == want


def test_packed_ticks_of_many_symbols():
    batch = pa.RecordBatch.from_pydict({"symbol": ["b", "a", "b", "c"], "event_id": [1, 2, 3, 4], "ts": [10, 20, 30, 40], "price": [1.0, 2.0, 3.0, 4.0]})
    got = {r["symbol"]: np.frombuffer(r["ticks"], keyed.TICK).tolist() for b in keyed.packed(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()}
    assert got == {"a": [(20, 2, 2.0)], "b": [(10, 1, 1.0), (30, 3, 3.0)], "c": [(40, 4, 4.0)]}


def test_ticks_with_nulls_fire_nothing(spark):
    at = pd.Timestamp("2024-03-01").to_pydatetime()
    ticks = [("A", 1, at, None), ("A", 2, None, 99.0), (None, 3, at, 99.0), ("A", 4, at, float("nan")), ("A", 5, at, 99.0)]
    alerts = [(1, 1, "A", "above", 90.0, "once"), (2, 2, "A", "below", None, "daily"), (3, 3, None, "above", 90.0, "once"), (4, 4, "A", "below", 99.0, "daily")]
    known = spark.createDataFrame(alerts, "alert_id long, user_id long, symbol string, direction string, threshold double, cadence string")
    path = shared.folder(spark)
    spark.createDataFrame(ticks, TICKS).coalesce(1).write.parquet(f"{path}/ticks")
    drained(keyed.alert_stream(spark.readStream.schema(TICKS).parquet(f"{path}/ticks"), known, buckets=2), path)
    assert sorted((r.alert_id, r.event_id, r.ts) for r in spark.read.parquet(f"{path}/rows").collect()) == [(1, 5, at), (4, 5, at)]


def test_quota_over_restarts_and_still_users(spark):
    draw = np.random.default_rng(7)
    start = pd.Timestamp("2024-03-01")
    rows = [(i, int(draw.integers(0, 4)), (start + pd.Timedelta(minutes=int(m))).to_pydatetime()) for i, m in enumerate(np.sort(draw.integers(0, 60 * 24 * 12, 200)))]
    path, kind = shared.folder(spark), "event_id long, user_id long, ts timestamp"
    for part in (rows[:80], rows[80:81], rows[81:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{path}/asked")
        drained(keyed.quota_stream(spark.readStream.schema(kind).parquet(f"{path}/asked"), late="30 days"), path)
    held, want = {}, {}
    for event, user, ts in rows:
        mine = [t for t in held.get(user, []) if ts - t < pd.Timedelta(hours=24)]
        want[event] = len(mine) < 3
        held[user] = [*mine, ts] if want[event] else mine
    assert {r.event_id: r.accepted for r in spark.read.parquet(f"{path}/rows").collect()} == want


def test_digest_days_across_a_clock_change(spark):
    """Ticks each half hour over two weeks around the change of clocks in New York and London: one digest a market and weekday."""
    ticks = [((pd.Timestamp("2024-03-04") + pd.Timedelta(minutes=30 * i)).to_pydatetime(),) for i in range(48 * 30)]
    markets = spark.createDataFrame([("US", "America/New_York"), ("GB", "Europe/London"), ("IN", "Asia/Kolkata")], "market string, zone string")
    path = shared.folder(spark)
    for part in (ticks[:501], ticks[501:]):
        spark.createDataFrame(part, "ts timestamp").coalesce(1).write.mode("append").parquet(f"{path}/clock")
        drained(keyed.digest_days(spark.readStream.schema("ts timestamp").parquet(f"{path}/clock"), markets), path)
    got = sorted((r.market, str(r.day)) for r in spark.read.parquet(f"{path}/rows").collect())
    days = [str(d.date()) for d in pd.bdate_range("2024-03-04", "2024-04-02")]
    assert got == sorted((m, d) for m in ("US", "GB", "IN") for d in days)


def test_digests_leave_the_bodies_where_they_are(spark):
    """One market with all bodies is many tasks' work: the due days are broadcast, also where Spark would not by itself."""
    markets = spark.createDataFrame([("US", "Z", "United States"), ("GB", "Y", "United Kingdom")], "market string, zone string, name string")
    due = spark.createDataFrame([("US", "Z", "2024-03-04"), ("US", "Z", "2024-03-05"), ("GB", "Y", "2024-03-04")], "market string, zone string, day string")
    bodies = spark.range(0, 900, 1, 6).select(F.col("id").alias("user_id"), F.when(F.col("id") < 10, "IN").otherwise("US").alias("market"), F.lit("b").alias("body"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        told = streams.digests(due, markets, bodies)
        assert "hashpartitioning(market" not in told._jdf.queryExecution().executedPlan().toString()
        at = F.spark_partition_id().alias("at")
        assert told.select(at).distinct().count() == 6
        assert sorted(map(tuple, told.collect())) == sorted((u, "US", d, "Morning Brief — United States", "b") for u in range(10, 900) for d in ("2024-03-04", "2024-03-05"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_changes_are_those_of_the_quotes(spark):
    want = quotes(spark, SMALL).select("symbol", "k", "change_pct")
    assert sorted(map(tuple, changes(spark, SMALL).collect())) == sorted(map(tuple, want.collect()))


def test_scoring_is_done_once_though_batches_are_repeated(spark):
    path, kind = shared.folder(spark), "id long, at int"
    known = {"now": 0}
    scorer = Scorer(spark, path, spark.createDataFrame([], kind).schema, "id", lambda rows: rows.withColumn("realised", F.when(F.col("at") + 5 <= known["now"], F.col("at") * 2.0)))
    drops = [[(1, 0), (2, 3), (3, 9)], [(2, 3), (4, 4), (5, 30)], [(1, 0), (6, 12)]]
    for drop, now in zip(drops, (6, 14, 20), strict=True):
        known["now"] = now
        spark.createDataFrame(drop, kind).coalesce(1).write.mode("append").parquet(f"{path}/arrived")
        scorer.drain(f"{path}/arrived")
        scorer.take(spark.createDataFrame(drop, kind), scorer._done()[-1])
        scorer.drain(f"{path}/arrived")
    assert sorted(map(tuple, scorer.outcomes().select("id", "realised").collect())) == [(1, 0.0), (2, 6.0), (3, 18.0), (4, 8.0), (6, 24.0)]
    assert [r.id for r in scorer.pending().collect()] == [5]


@pytest.fixture
def held(spark):
    return CommittedTable(spark, shared.folder(spark), "k long, at int, v string", ["k"], buckets=4)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_versions_of_a_committed_table(spark, held):
    kind = "k long, at int, v string"
    assert held.read().count() == 0 and held.versions() == []
    held.upsert(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "n")], kind), ["at"])
    held.upsert(spark.createDataFrame([(2, 0, "d"), (3, 1, "e"), (3, 1, "e"), (None, 0, "m")], kind), ["at"])
    held.upsert(spark.createDataFrame([(1, 9, "x"), (4, 2, "g"), (4, 1, "f")], kind), ["at"], update=False)
    assert held.versions() == [1, 2, 3]
    assert rows_of(held.read(1).fillna(-1)) == [(-1, 1, "n"), (1, 2, "b"), (2, 1, "c")]
    assert rows_of(held.read(2).fillna(-1)) == [(-1, 0, "m"), (1, 2, "b"), (2, 0, "d"), (3, 1, "e")]
    assert rows_of(held.read().fillna(-1)) == [(-1, 0, "m"), (1, 2, "b"), (2, 0, "d"), (3, 1, "e"), (4, 1, "f")]
    held.upsert(spark.createDataFrame([], kind), ["at"])
    assert rows_of(held.read().fillna(-1)) == rows_of(held.read(3).fillna(-1))


def test_a_failed_or_slower_writer_changes_nothing(spark, held, monkeypatch):
    kind = "k long, at int, v string"
    held.upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], kind), ["at"])
    bad = spark.createDataFrame([(1, 2, "z")], kind).withColumn("v", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        held.upsert(bad, ["at"])
    assert rows_of(held.read()) == [(1, 1, "a"), (2, 1, "b")] and held.versions() == [1]
    slow = CommittedTable(spark, held.path, kind, ["k"], buckets=4)
    monkeypatch.setattr(slow, "versions", lambda: [])
    with pytest.raises(Conflict):
        slow.upsert(spark.createDataFrame([(7, 1, "late")], kind), ["at"])
    assert rows_of(held.read()) == [(1, 1, "a"), (2, 1, "b")] and held.versions() == [1]


def test_untouched_buckets_keep_their_files(spark, held):
    kind = "k long, at int, v string"
    held.upsert(spark.createDataFrame([(i, 1, "a") for i in range(40)], kind), ["at"])
    held.upsert(spark.createDataFrame([(5, 2, "b")], kind), ["at"])
    first, second = held._manifest(1), held._manifest(2)
    assert sum(first[b] != second[b] for b in first) == 1 and held.read().count() == 40
