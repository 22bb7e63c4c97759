"""Ordered state machines of users' rows, in pandas; imported by executors, so free of Spark.

Rows come sorted by user and time, in batches that may cut a user's rows anywhere; between
batches only the state of one user is held, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd

CASH = 100_000.0
LIMIT = 3
DAY, PAUSE = pd.Timedelta(hours=24), pd.Timedelta(hours=20)
ACCOUNT = "user_id long, cash double, holdings int, trades int, rejected int, realised double"


def folded(start: Callable[[], dict], step: Callable[[dict, tuple], bool]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows for which ``step(state, row)`` is true are marked ``kept``; each user begins with ``start()``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, start()
        for frame in frames:
            kept = []
            for row in frame.itertuples(index=False):
                if row.user_id != user:
                    user, state = row.user_id, start()
                kept.append(step(state, row))
            yield frame.assign(kept=pd.Series(kept, index=frame.index, dtype=bool))

    return run


def within_quota(state: dict, row: tuple) -> bool:
    """Accepted while fewer than LIMIT were accepted within the 24 hours before."""
    state["accepted"] = [t for t in state.get("accepted", []) if row.ts - t < DAY]
    if len(state["accepted"]) >= LIMIT:
        return False
    state["accepted"].append(row.ts)
    return True


def fires(state: dict, row: tuple) -> bool:
    """The first tick fires, then each at least 20 hours after the last that fired."""
    if "last" in state and row.ts - state["last"] < PAUSE:
        return False
    state["last"] = row.ts
    return True


class Account:
    """Cash and average-cost positions; a trade that the account cannot cover is rejected."""

    def __init__(self, user: int):
        self.user, self.cash, self.realised, self.trades, self.rejected, self.held = user, CASH, 0.0, 0, 0, {}

    def trade(self, row: tuple) -> None:
        shares, cost = self.held.get(row.symbol, (0.0, 0.0))
        amount = row.shares * row.price
        if shares < row.shares if row.sell else self.cash < amount:
            self.rejected += 1
            return
        self.trades += 1
        if row.sell:
            self.cash, self.realised = self.cash + amount, self.realised + row.shares * (row.price - cost)
            self.held[row.symbol] = (shares - row.shares, cost)
        else:
            self.cash -= amount
            self.held[row.symbol] = (shares + row.shares, (shares * cost + amount) / (shares + row.shares))

    def row(self) -> tuple:
        return self.user, self.cash, sum(s > 0 for s, _ in self.held.values()), self.trades, self.rejected, self.realised


def accounts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The final state of each user's account."""
    now, columns = None, [c.split()[0] for c in ACCOUNT.split(", ")]
    for frame in frames:
        done = []
        for row in frame.itertuples(index=False):
            if now is None or row.user_id != now.user:
                done += [now.row()] if now else []
                now = Account(row.user_id)
            now.trade(row)
        yield pd.DataFrame(done, columns=columns)
    if now:
        yield pd.DataFrame([now.row()], columns=columns)
