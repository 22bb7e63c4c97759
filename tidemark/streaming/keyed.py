"""State machines of one key over endless rows, kept by the stream's state store.

Rows of a micro-batch are taken in order of (ts, event_id); a restart goes on from the
checkpoint, so what has been told is not told again.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRED = "alert_id long, user_id long, symbol string, event_id long, ts timestamp, price double"
DECIDED = "event_id long, user_id long, ts timestamp, accepted boolean"


def in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(frames, ignore_index=True).sort_values(["ts", "event_id"], ignore_index=True)


# Ticks and alerts as they travel and lie in state: records of numbers, many to a row.
TICK = np.dtype([("ts", "i8"), ("event_id", "i8"), ("price", "f8")])
ALERT = np.dtype([("alert_id", "i8"), ("user_id", "i8"), ("above", "?"), ("daily", "?"), ("threshold", "f8"), ("last", "i8")])
NEVER = np.iinfo("i8").min


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each symbol of a batch of ticks, with its ticks as records."""
    for batch in batches:
        ticks, symbols = np.empty(batch.num_rows, TICK), batch["symbol"].dictionary_encode()
        for name in TICK.names:
            ticks[name] = batch[name].to_numpy()
        codes = symbols.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        ends = np.searchsorted(codes[order], np.arange(len(symbols.dictionary)), "right")
        parts = [ticks[places].tobytes() for places in np.split(order, ends)[:-1]]
        yield pa.RecordBatch.from_arrays([symbols.dictionary, pa.array(parts, pa.binary())], ["symbol", "ticks"])


class Maxima:
    """Maxima of blocks of 1, 2, 4, ... values: where values first reach a bound is found in steps of their logarithm."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [values]
        while len(self.levels[-1]) > 1:
            if len(self.levels[-1]) % 2:
                self.levels[-1] = np.append(self.levels[-1], -np.inf)
            self.levels.append(np.maximum(self.levels[-1][::2], self.levels[-1][1::2]))

    def first(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each start and bound the first place from ``start`` on whose value is at least ``bound``; n where there is none."""
        if not self.n:
            return np.zeros(len(start), "i8")
        at, top = start.astype("i8"), len(self.levels) - 1
        found, left = np.full(len(at), -1), np.arange(len(at))
        # Up: a block that begins at a left child is looked at as part of its parent.
        for level, maxima in enumerate(self.levels[:-1]):
            place = at[left]
            hit = place % 2 == 1
            right = hit.copy()
            hit[right] = maxima[place[right]] >= bound[left[right]]
            found[left[hit]] = level
            left = left[~hit]
            at[left] = (at[left] + 1) // 2
        left = left[at[left] == 0]
        found[left[self.levels[top][0] >= bound[left]]] = top
        # Down, to the left child if it reaches the bound.
        for level in range(top, 0, -1):
            down = np.flatnonzero(found >= level)
            child = at[down] * 2
            at[down] = child + (self.levels[level - 1][child] < bound[down])
        return np.where(found < 0, self.n, np.minimum(at, self.n))


class Side:
    """A symbol's ticks in order of (ts, event_id), for the alerts above (sign 1) or below (sign -1) a threshold."""

    def __init__(self, sign: int, alerts: list[np.ndarray]):
        self.sign, self.parts = sign, [np.empty(0, TICK)]
        self.least = min((self.bounds(a, self.mine(a)).min(initial=np.inf) for a in alerts), default=np.inf)

    def mine(self, alerts: np.ndarray) -> np.ndarray:
        return np.flatnonzero(alerts["above"] == (self.sign > 0))

    def bounds(self, alerts: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self.sign * alerts["threshold"][places]

    def take(self, ticks: np.ndarray) -> None:
        """Ticks that no alert of this side can fire on are left out."""
        self.parts.append(ticks[self.sign * ticks["price"] >= self.least])

    def sort(self) -> None:
        ticks = np.concatenate(self.parts)
        self.parts = []
        self.ticks = ticks[np.lexsort((ticks["event_id"], ticks["ts"]))]
        self.times, self.maxima = self.ticks["ts"].copy(), Maxima(self.sign * self.ticks["price"])

    def fire(self, alerts: np.ndarray, pause: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of alerts and the ticks with which they fire, once each a round; sets ``last``."""
        mine = self.mine(alerts)
        while len(mine):
            at = self.maxima.first(np.searchsorted(self.times, alerts["last"][mine] + pause), self.bounds(alerts, mine))
            mine, at = mine[at < len(self.times)], at[at < len(self.times)]
            alerts["last"][mine] = self.times[at]
            yield mine, self.ticks[at]
            mine = mine[alerts["daily"][mine]]


class PriceAlerts(StatefulProcessor):
    """Alerts on one symbol: ``once`` goes when it fires, ``daily`` rests for ``pause`` hours after it.

    Alerts lie in state by the block, so that state is read and written once a block and not
    once an alert, and all alerts of a block look for their next tick at once.
    """

    def __init__(self, pause: int = 20):
        self.pause = pause * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alerts = handle.getMapState("alerts", "first long", "block binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        block = np.empty(len(initialState), ALERT)
        for name in ("alert_id", "user_id", "threshold"):
            block[name] = initialState[name]
        block["above"], block["daily"], block["last"] = initialState["direction"] == "above", initialState["cadence"] == "daily", NEVER
        if len(block):
            self.alerts.updateValue((int(block["alert_id"][0]),), (block.tobytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(first, np.frombuffer(block, ALERT).copy()) for first, (block,) in self.alerts.iterator()]
        sides = [Side(sign, [block for _, block in held]) for sign in (1, -1)]
        for frame in rows:
            for ticks in frame["ticks"]:
                for side in sides:
                    side.take(np.frombuffer(ticks, TICK))
        for side in sides:
            side.sort()
        for first, block in held:
            fired = [pair for side in sides for pair in side.fire(block, self.pause) if len(pair[0])]
            if not fired:
                continue
            who, ticks = (np.concatenate(part) for part in zip(*fired, strict=True))
            left = block[block["daily"] | (block["last"] == NEVER)]
            if len(left):
                self.alerts.updateValue(first, (left.tobytes(),))
            else:
                self.alerts.removeKey(first)
            times = pd.Series(ticks["ts"].astype("M8[us]")).dt.tz_localize("UTC")
            yield pd.DataFrame({"alert_id": block["alert_id"][who], "user_id": block["user_id"][who], "symbol": key[0], "event_id": ticks["event_id"], "ts": times, "price": ticks["price"]})

    def close(self) -> None:
        pass


class RollingQuota(StatefulProcessor):
    """At most ``limit`` accepted requests of a user within ``hours``; a timer forgets users who have been still for as long."""

    def __init__(self, limit: int = 3, hours: int = 24):
        self.limit, self.span = limit, timedelta(hours=hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "ts timestamp")
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = in_order(rows)
        held = [pd.Timestamp(ts).tz_localize(None) for (ts,) in self.accepted.get()] if self.accepted.exists() else []
        answers = []
        for ts in asked["ts"]:
            held = [t for t in held if ts - t < self.span]
            answers.append(len(held) < self.limit)
            if answers[-1]:
                held.append(ts)
        self.accepted.put([(t.to_pydatetime(),) for t in held])
        if held:
            self._wake(int((held[-1] + self.span).timestamp() * 1000))
        yield asked.assign(accepted=answers)[["event_id", "user_id", "ts", "accepted"]]

    def _wake(self, at: int) -> None:
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        self.handle.registerTimer(at)
        self.until.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.accepted.clear()
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def alert_stream(ticks: DataFrame, alerts: DataFrame, buckets: int = 4, pause: int = 20) -> DataFrame:
    """Firings of ``alerts`` (alert_id, user_id, symbol, direction, threshold, cadence) on a stream of ticks (symbol, event_id, ts, price).

    A symbol's alerts are dealt over ``buckets`` keys, and its ticks go to each, so that one
    symbol with many alerts is many tasks' work.  A task holds 24 bytes of each tick of its
    symbol in the micro-batch.  Ticks with a null and alerts without id, user, symbol or threshold
    fire nothing.
    """
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    whole = ticks.select("symbol", F.col("event_id").cast("long").alias("event_id"), F.unix_micros("ts").alias("ts"), F.col("price").cast("double").alias("price")).na.drop()
    dealt = whole.mapInArrow(packed, "symbol string, ticks binary").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    known = alerts.na.drop(subset=["alert_id", "user_id", "symbol", "threshold"]).select("symbol", F.pmod(F.xxhash64("alert_id"), F.lit(buckets)).cast("int").alias("bucket"), "alert_id", "user_id", "direction", "threshold", "cadence")
    return dealt.groupBy("symbol", "bucket").transformWithStateInPandas(PriceAlerts(pause), FIRED, "Append", "None", known.groupBy("symbol", "bucket"))


def quota_stream(requests: DataFrame, limit: int = 3, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Whether each request (event_id, user_id, ts) is within its user's rolling quota; later ones than ``late`` are dropped."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return requests.select("event_id", "user_id", "ts").withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(RollingQuota(limit, hours), DECIDED, "Append", "EventTime")


def digest_days(clock: DataFrame, markets: DataFrame, hour: int = 9, late: str = "2 hours") -> DataFrame:
    """(market, zone, day): the local weekdays on which the clock (a stream of ts) has reached ``hour`` in the market's zone, once each."""
    local = F.from_utc_timestamp("ts", F.col("zone"))
    due = clock.select("ts").withWatermark("ts", late).join(F.broadcast(markets), F.lit(True)).withColumn("local", local)
    due = due.filter((F.hour("local") == hour) & F.dayofweek("local").between(2, 6)).withColumn("day", F.to_date("local"))
    return due.select("ts", "market", "zone", "day").dropDuplicatesWithinWatermark(["market", "day"]).select("market", "zone", "day")
