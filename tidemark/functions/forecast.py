"""Walk-forward models of one series, in numpy over all cut points at once; imported by executors, so free of Spark.

A cut point is a row to forecast; its training rows are a window that ends before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

# Fixed values of the forecaster: epochs, step, penalty of the direction model, clip of its
# exponent, winsor limit, least deviation, and the settings of an asset class (training
# window, least training rows, ridge penalty, caps of the return by horizon in percent,
# scenario multiplier).
EPOCHS, STEP, PENALTY, EXPONENT, WINSOR, LEAST_SD = 300, 0.15, 1.0, 30.0, 4.0, 1e-9
ASSETS = {
    "equity": (220, 90, 1.8, 3.5, 6.5, 12.0, 1.0),
    "gold": (260, 110, 1.4, 1.8, 3.8, 7.0, 0.8),
    "oil": (260, 110, 1.3, 2.2, 5.5, 10.0, 1.25),
    "crypto": (200, 80, 2.4, 6.0, 12.0, 20.0, 1.5),
    "index": (240, 100, 1.6, 2.4, 4.8, 8.8, 0.9),
}
#: Cut points of a series that are judged, and those that are fitted together.
LAST, TOGETHER = 120, 40
FEATURES = ("r1", "r5", "r10", "r20", "sd5", "sd10", "ma10", "ma20", "top20", "place20", "rsi", "volume", "macd", "band", "relative")
FORECAST = "symbol string, i long, date date, ridge double, up double, sign int, high_vol boolean, actual double"


class Windows:
    """Standardised training windows of many cut points, as one array (cut, row, feature) with a mask of the rows in use."""

    def __init__(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, end: np.ndarray):
        rows = first[:, None] + np.arange(int((end - first).max()))
        self.used = rows < end[:, None]
        rows = np.minimum(rows, len(x) - 1)
        count = self.used.sum(axis=1)[:, None]
        raw, used = x[rows], self.used[..., None]
        self.mean = (raw * used).sum(axis=1) / count
        sd = np.sqrt((((raw - self.mean[:, None]) ** 2) * used).sum(axis=1) / count)
        self.raw_sd, self.sd = sd, np.where(sd < LEAST_SD, 1.0, sd)
        self.count = count[:, 0]
        self.x = self.scaled(raw) * used
        self.y = np.where(self.used, y[rows], 0.0)

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        """Rows (cut, row, feature) by each window's moments, winsorised, with a leading 1 for the bias."""
        z = np.clip((rows - self.mean[:, None]) / self.sd[:, None], -WINSOR, WINSOR)
        return np.concatenate([np.ones((*z.shape[:2], 1)), z], axis=2)

    def ridge(self, penalty: float) -> np.ndarray:
        """Weights of each window by its normal equations; the bias bears no penalty."""
        extra = np.full(self.x.shape[2], penalty)
        extra[0] = 0.0
        gram = np.einsum("cni,cnj->cij", self.x, self.x) + np.diag(extra)
        return np.linalg.solve(gram, np.einsum("cni,cn->ci", self.x, self.y)[..., None])[..., 0]

    def direction(self, penalty: float = PENALTY) -> np.ndarray:
        """Weights of the probability of a rise, after a fixed number of full gradient steps from zero."""
        rises, weights = (self.y > 0).astype(float), np.zeros((len(self.x), self.x.shape[2]))
        shrink = np.full(self.x.shape[2], penalty)
        shrink[0] = 0.0
        for _ in range(EPOCHS):
            odds = np.clip(np.einsum("cni,ci->cn", self.x, weights), -EXPONENT, EXPONENT)
            error = np.where(self.used, 1 / (1 + np.exp(-odds)) - rises, 0.0)
            weights -= STEP * (np.einsum("cni,cn->ci", self.x, error) + shrink * weights) / self.count[:, None]
        return weights


def tie_break(ridge: np.ndarray, up: np.ndarray, typical: np.ndarray) -> np.ndarray:
    """The ridge's sign, or the direction model's where the ridge is small against the typical move and the model is sure."""
    unsure = np.abs(ridge) < 0.3 * typical
    sign = np.where(ridge >= 0, 1, -1)
    return np.where(unsure & (up >= 0.6), 1, np.where(unsure & (up <= 0.4), -1, sign))


def walk_forward(frame: pd.DataFrame, asset: str = "equity", expanding: bool = False, ridge_penalty: float | None = None, direction_penalty: float = PENALTY, vol_limit: float | None = 1.5) -> pd.DataFrame:
    """Forecasts of the last LAST rows of a symbol (symbol, i, date, FEATURES, target), each from the rows before it.

    Only rows with a target take part.  ``high_vol`` marks rows whose ten-day deviation is
    more than ``vol_limit`` deviations above its mean in the training window.
    """
    window, least, alpha = ASSETS[asset][:3]
    frame = frame[frame["target"].notna()].sort_values("i").reset_index(drop=True)
    x, y = frame[list(FEATURES)].to_numpy(float), frame["target"].to_numpy(float)
    cuts = np.arange(max(least, len(frame) - LAST), len(frame))
    parts = []
    for at in range(0, len(cuts), TOGETHER):
        now = cuts[at : at + TOGETHER]
        first = np.zeros_like(now) if expanding else np.maximum(now - window, 0)
        fit = Windows(x, y, first, now)
        point = fit.scaled(x[now][:, None])[:, 0]
        ridge = (point * fit.ridge(alpha if ridge_penalty is None else ridge_penalty)).sum(axis=1)
        odds = np.clip((point * fit.direction(direction_penalty)).sum(axis=1), -EXPONENT, EXPONENT)
        up = 1 / (1 + np.exp(-odds))
        typical = np.array([np.median(np.abs(y[a:b])) for a, b in zip(first, now, strict=True)])
        vol = FEATURES.index("sd10")
        high = np.zeros(len(now), bool) if vol_limit is None else (fit.raw_sd[:, vol] > LEAST_SD) & (x[now, vol] > fit.mean[:, vol] + vol_limit * fit.raw_sd[:, vol])
        parts.append(pd.DataFrame({"symbol": frame["symbol"].to_numpy()[now], "i": frame["i"].to_numpy()[now], "date": frame["date"].to_numpy()[now], "ridge": ridge, "up": up, "sign": tie_break(ridge, up, typical).astype("int32"), "high_vol": high, "actual": y[now]}))
    return pd.concat(parts) if parts else pd.DataFrame(columns=[c.split()[0] for c in FORECAST.split(", ")], dtype=object)


def live(frame: pd.DataFrame, asset: str = "equity") -> tuple[float, np.ndarray]:
    """The ridge forecast of a symbol's last row, and its weights, from the newest window of rows with a target."""
    window, _, alpha = ASSETS[asset][:3]
    frame = frame.sort_values("i")
    known = frame[frame["target"].notna()]
    x, y = known[list(FEATURES)].to_numpy(float)[-window:], known["target"].to_numpy(float)[-window:]
    fit = Windows(x, y, np.array([0]), np.array([len(x)]))
    weights = fit.ridge(alpha)[0]
    return float(fit.scaled(frame[list(FEATURES)].to_numpy(float)[-1:][None])[0, 0] @ weights), weights


def ridge_walk(frame: pd.DataFrame, horizon: int, asset: str = "equity") -> pd.DataFrame:
    """Of each row of a symbol (symbol, i, FEATURES, target; targets reach ``horizon`` rows ahead): walk and model.

    ``walk`` is the ridge forecast from the window of rows before a row, as the backtest makes
    it; ``model`` is the one made at that row, from the window of rows whose targets are
    known there.  One fit serves both: the window that ends before row e is what is known
    at row e + horizon - 1.  NaN where there are too few rows.
    """
    window, least, alpha = ASSETS[asset][:3]
    frame = frame.sort_values("i")
    x, y = frame[list(FEATURES)].to_numpy(float), frame["target"].to_numpy(float)
    known = max(len(x) - horizon, 0)
    walk, model = np.full(len(x), np.nan), np.full(len(x), np.nan)
    for at in range(least, known + 1, TOGETHER):
        ends = np.arange(at, min(at + TOGETHER, known + 1))
        fit = Windows(x, np.nan_to_num(y), np.maximum(ends - window, 0), ends)
        weights = fit.ridge(alpha)
        for out, rows in ((walk, ends), (model, ends + horizon - 1)):
            out[rows] = (fit.scaled(x[rows][:, None])[:, 0] * weights).sum(axis=1)
    walk[known:] = np.nan
    return pd.DataFrame({"symbol": frame["symbol"].to_numpy(), "i": frame["i"].to_numpy(), "walk": walk, "model": model, "actual": y})


def stationary_indices(n: int, block: float, rng: np.random.Generator) -> np.ndarray:
    """Stationary bootstrap: blocks of geometric length, wrapped around."""
    fresh = rng.random(n) < 1 / block
    fresh[0] = True
    start = rng.integers(0, n, n)
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(fresh, at, 0))
    return (start[last] + at - last) % n


def sharpe(r: np.ndarray) -> float:
    sd = r.std()
    return 0.0 if sd < 1e-12 else float(np.sqrt(252) * r.mean() / sd)


def har_forecasts(frame: pd.DataFrame, h: int = 21, every: int = 21, start: int = 500, least: int = 260) -> pd.DataFrame:
    """Variance forecasts of a symbol (symbol, i, ret) by log regression on daily, weekly and monthly variance.

    At each cut point only returns before it are known, so the last h targets are not.
    Short histories take the variance of the last h returns.
    """
    frame = frame.sort_values("i")
    r = frame["ret"].to_numpy(float)
    r, numbers = r[~np.isnan(r)], frame["i"].to_numpy()[~np.isnan(r)]
    v = r**2
    sums = np.r_[0.0, np.cumsum(v)]
    mean = lambda n: np.r_[np.full(n - 1, np.nan), (sums[n:] - sums[:-n]) / n]
    logs = np.log(np.maximum(np.c_[v, mean(5), mean(22)], 1e-12)) if len(r) >= 22 else np.zeros((0, 3))
    rows = []
    for cut in range(start, len(r) - h, every):
        past = r[:cut]
        value = float(past[-h:].var())
        low, high = 22, cut - h
        if cut >= least and high - low >= 100:
            design = np.c_[logs[low:high], np.ones(high - low)]
            goal = np.log(np.maximum((sums[low + 1 + h : high + 1 + h] - sums[low + 1 : high + 1]) / h, 1e-12))
            beta = np.linalg.lstsq(design, goal, rcond=None)[0]
            value = float(np.exp(np.clip(np.r_[logs[cut - 1], 1.0] @ beta, -30, 5)))
        rows.append((frame["symbol"].iloc[0], int(numbers[cut]), value, float(past[-h:].var()), float(v[cut : cut + h].mean())))
    return pd.DataFrame(rows, columns=["symbol", "i", "har", "rw", "realised"])
