"""Ordered recursions over one symbol's bars, in pandas; imported by executors, so free of Spark."""

from __future__ import annotations

import pandas as pd


def _ema(values: pd.Series, n: int) -> pd.Series:
    """Seeded with the mean of the first n values, null before."""
    seed = values.copy()
    if len(values) < n:
        return pd.Series([float("nan")] * len(values), index=values.index)
    seed.iloc[: n - 1] = float("nan")
    seed.iloc[n - 1] = values.iloc[:n].mean()
    return seed.iloc[n - 1 :].ewm(alpha=2 / (n + 1), adjust=False).mean().reindex(values.index)


def _wilder(values: pd.Series, n: int) -> pd.Series:
    seed = values.iloc[1:].copy()
    if len(seed) < n:
        return pd.Series([float("nan")] * len(values), index=values.index)
    seed.iloc[n - 1] = seed.iloc[:n].mean()
    return seed.iloc[n - 1 :].ewm(alpha=1 / n, adjust=False).mean().reindex(values.index)


def indicators(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("date").reset_index(drop=True)
    close = frame["close"]
    fast, slow = _ema(close, 12), _ema(close, 26)
    flat = fast.fillna(close.iloc[:12].mean() if len(close) >= 12 else close.mean())
    change = close.diff()
    gain, loss = _wilder(change.clip(lower=0), 14), _wilder((-change).clip(lower=0), 14)
    rsi = 100 - 100 / (1 + gain / loss.where(loss > 0))
    rsi = rsi.where(loss != 0, 100.0).where(gain.notna())
    line = fast - slow
    signal = _ema(line.fillna(0.0), 9)
    ret = close.pct_change().iloc[1:]
    variance = pd.Series([float("nan")] * len(close))
    if len(ret) >= 22:
        path = (ret**2).copy()
        path.iloc[21] = ret.iloc[:22].var(ddof=0)
        variance = path.iloc[21:].ewm(alpha=0.06, adjust=False).mean().reindex(close.index)
    return pd.DataFrame({
        "symbol": frame["symbol"], "date": frame["date"], "i": frame["i"], "close": close, "ema12": fast, "ema26": slow, "ema_flat": flat, "rsi": rsi,
        "macd": line, "signal": signal.where(line.notna()), "hist": (line - signal).where(line.notna()), "ewma_var": variance,
    })
