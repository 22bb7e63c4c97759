"""GARCH(1,1) by maximum likelihood, many cut points of one series at once; imported by executors, so free of Spark.

Variance of day t: omega + alpha r(t-1)^2 + beta variance(t-1), from the mean square of the
history on.  Parameters are sought as log omega and the shares of a softmax, so that omega is
positive and alpha + beta below 1.  Each iteration runs the recursion and its derivatives over
the days of all cut points beside each other, and takes a damped Fisher step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: (alpha, beta) that the search begins with; the likeliest of them.
STARTS = ((0.05, 0.90), (0.10, 0.80), (0.20, 0.50), (0.02, 0.97))
ROUNDS, TOLERANCE, LEAST, CELLS = 40, 1e-4, 100, 1 << 19


def natural(theta: np.ndarray) -> np.ndarray:
    """omega, alpha, beta of each column of theta."""
    a, b = np.exp(np.clip(theta[1:], -30, 30))
    return np.stack([np.exp(np.clip(theta[0], -60, 30)), a / (1 + a + b), b / (1 + a + b)])


def searched(natural_values: np.ndarray) -> np.ndarray:
    omega, alpha, beta = natural_values
    rest = 1 - alpha - beta
    return np.stack([np.log(omega), np.log(alpha / rest), np.log(beta / rest)])


def _recursed(values: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """y(t) = values(t) + keep * y(t - 1) down each column, by sums over spans that double."""
    y, span, power = values.copy(), 1, keep
    while span < len(y) and power.max() > 1e-18:
        y[span:] += power * y[:-span]
        span, power = 2 * span, power * power
    return y


def likelihood(square: np.ndarray, cuts: np.ndarray, params: np.ndarray, slopes: bool = False):
    """Log likelihood of the first cuts[k] squares under params[:, k], the variance after them, and with ``slopes`` gradient and information in the natural parameters."""
    omega, alpha, beta = params
    days, columns = int(cuts.max()) + 1, np.arange(len(cuts))
    before = np.r_[0.0, square[: days - 1]][:, None]
    given = np.broadcast_to(omega, (days, len(cuts))) + alpha * before
    given[0] = np.cumsum(square)[cuts - 1] / cuts
    variance = _recursed(given, beta)
    live = np.arange(days)[:, None] < cuts
    inverse = live / variance
    ratio = np.r_[square, 0.0][:days, None] * inverse
    total = -0.5 * (np.where(live, np.log(variance), 0.0) + ratio).sum(0)
    after = variance[cuts, columns]
    if not slopes:
        return total, after
    ones = np.ones((days, len(cuts)))
    ones[0] = 0.0
    lagged = np.concatenate([np.zeros((1, len(cuts))), variance[:-1]])
    scaled = np.stack([_recursed(x, beta) for x in (ones, before * ones, lagged)]) * inverse
    gradient = 0.5 * (scaled * (ratio - live)).sum(1)
    return total, after, gradient, 0.5 * np.einsum("itk,jtk->ijk", scaled, scaled)


def _chain(params: np.ndarray) -> np.ndarray:
    """Derivatives of the natural parameters by the searched ones."""
    omega, alpha, beta = params
    zero = np.zeros_like(omega)
    return np.array([[omega, zero, zero], [zero, alpha * (1 - alpha), -alpha * beta], [zero, -alpha * beta, beta * (1 - beta)]])


def fit(returns: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parameters (3, cuts), log likelihoods, the variance of the next day, and whether each fit has converged.

    Cut points are taken in blocks of at most ``CELLS`` days times points.
    """
    width = max(1, CELLS // (int(cuts.max()) + 1))
    return tuple(np.concatenate(x, axis=-1) for x in zip(*(_fit(returns, cuts[k : k + width]) for k in range(0, len(cuts), width)), strict=True))


def _fit(returns: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``fit`` of one block; values are scaled to percent, parameters and variances are those of the returns given."""
    square = (returns * 100.0) ** 2
    level = np.maximum(np.cumsum(square)[cuts - 1] / cuts, 1e-12)
    tried = [np.stack([level * (1 - a - b), np.full(len(cuts), a), np.full(len(cuts), b)]) for a, b in STARTS]
    found = np.array([likelihood(square, cuts, p)[0] for p in tried])
    theta = searched(np.stack(tried)[found.argmax(0), :, np.arange(len(cuts))].T)
    damp, done = np.full(len(cuts), 1e-3), np.zeros(len(cuts), bool)
    total, after, gradient, information = likelihood(square, cuts, natural(theta), True)
    for _ in range(ROUNDS):
        chain = _chain(natural(theta))
        slope = np.einsum("ijc,ic->jc", chain, gradient)
        bend = np.einsum("iac,ijc,jbc->abc", chain, information, chain)
        bend = bend + np.eye(3)[:, :, None] * (damp * (1e-8 + np.trace(bend)))
        step = np.linalg.solve(bend.transpose(2, 0, 1), slope.T[:, :, None])[:, :, 0].T
        step = np.where(done, 0.0, np.clip(step, -2, 2))
        fresh = likelihood(square, cuts, natural(theta + step), True)
        better = np.isfinite(fresh[0]) & (fresh[0] >= total) & ~done
        done |= better & (fresh[0] - total < TOLERANCE) & (damp < 1)
        theta = np.where(better, theta + step, theta)
        total, after = np.where(better, fresh[0], total), np.where(better, fresh[1], after)
        gradient, information = np.where(better, fresh[2], gradient), np.where(better, fresh[3], information)
        damp = np.where(better, damp / 10, damp * 10)
        # No step, however short, makes it likelier: an end on the bounds or a flat top.
        done |= damp > 1e8
        if done.all():
            break
    params = natural(theta)
    return params * np.array([1e-4, 1, 1])[:, None], total, after * 1e-4, done


def smoothed(returns: np.ndarray, keep: float = 0.94, seed: int = 22) -> np.ndarray:
    """Exponentially weighted variance before each day, from the variance of the first ``seed`` returns on."""
    out = np.full(len(returns) + 1, returns[:seed].var() if len(returns) else np.nan)
    for t in range(seed, len(returns)):
        out[t + 1] = keep * out[t] + (1 - keep) * returns[t] ** 2
    return out


def garch_forecasts(frame: pd.DataFrame, h: int = 21, every: int = 21, start: int = 500) -> pd.DataFrame:
    """Mean variance forecasts of the next h days of a symbol (symbol, i, ret), from returns before each cut point only.

    Where the search does not converge, or the history is shorter than ``LEAST`` or has no
    variance, it is the variance of the last h returns.
    """
    frame = frame.sort_values("i")
    r = frame["ret"].to_numpy(float)
    r, numbers = r[~np.isnan(r)], frame["i"].to_numpy()[~np.isnan(r)]
    columns = ["symbol", "i", "garch", "rw", "mean", "ewma", "realised", "alpha", "beta", "converged"]
    cuts = np.arange(start, len(r) - h, every)
    if not len(cuts):
        return pd.DataFrame([], columns=columns)
    params, _, after, done = fit(r, cuts)
    omega, alpha, beta = params
    rho = alpha + beta
    level = omega / np.maximum(1 - rho, 1e-12)
    value = level + (after - level) * (1 - rho**h) / (h * np.maximum(1 - rho, 1e-12))
    last = np.array([r[c - h : c].var() for c in cuts])
    good = done & np.isfinite(value) & (value > 0) & (cuts >= LEAST) & np.array([r[:c].var() > 1e-16 for c in cuts])
    realised = [r[c : c + h].var() for c in cuts]
    every_day, smooth = [r[:c].var() for c in cuts], smoothed(r)[cuts]
    return pd.DataFrame(dict(zip(columns, (frame["symbol"].iloc[0], numbers[cuts], np.where(good, value, last), last, every_day, smooth, realised, alpha, beta, good), strict=True)))
