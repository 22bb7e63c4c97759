"""Resampling tests of daily series, one replicate a row; imported by executors, so free of Spark."""

from __future__ import annotations

import numpy as np

from tidemark.functions.forecast import sharpe, stationary_indices


def long_run_variance(d: np.ndarray, lag: int) -> float:
    """Newey-West variance with Bartlett weights."""
    e = d - d.mean()
    total = float(e @ e) / len(e)
    for k in range(1, min(lag, len(e) - 1) + 1):
        total += 2 * (1 - k / (lag + 1)) * float(e[k:] @ e[:-k]) / len(e)
    return max(total, 1e-30)


def difference_draw(a: np.ndarray, b: np.ndarray, block: float, seed: list[int]) -> float:
    """Difference of Sharpe ratios on one draw of days, the same for both series."""
    at = stationary_indices(len(a), block, np.random.default_rng(seed))
    return sharpe(a[at]) - sharpe(b[at])


class Search:
    """Outperformance of many models (days, models) against a benchmark, with what its null distributions need."""

    def __init__(self, d: np.ndarray, block: float):
        self.d, self.block, self.n = d, block, len(d)
        self.mean = d.mean(axis=0)
        self.omega = np.array([long_run_variance(c, max(1, round(block) - 1)) for c in d.T])
        # Models far below zero are recentred at zero, not at their own mean.
        bar = -np.sqrt(self.omega / self.n) * np.sqrt(2 * np.log(np.log(max(self.n, 3))))
        self.centre = np.where(self.mean >= bar, self.mean, 0.0)
        self.best = int(self.mean.argmax())

    def observed(self) -> tuple[float, float, float]:
        root = np.sqrt(self.n)
        return max(0.0, float((root * self.mean / np.sqrt(self.omega)).max())), max(0.0, float(root * self.mean.max())), float(self.mean[self.best])

    def draw(self, seed: list[int]) -> tuple[float, float, float]:
        """One replicate of the studentised maximum, the plain maximum, and the winner taken alone."""
        rng, root = np.random.default_rng(seed), np.sqrt(self.n)
        drawn = self.d[stationary_indices(self.n, self.block, rng)].mean(axis=0)
        alone = self.d[stationary_indices(self.n, self.block, rng), self.best].mean() - self.mean[self.best]
        return max(0.0, float((root * (drawn - self.centre) / np.sqrt(self.omega)).max())), max(0.0, float(root * (drawn - self.mean).max())), float(alone)


def simulated_test(days: int, effect: float, bench: float, rho: float, vol: float, draws: int, block: float, seed: list[int]) -> tuple[bool, float]:
    """Whether the interval of one simulated experiment leaves zero out, and its width."""
    rng = np.random.default_rng(seed)
    one, two = rng.normal(size=days), rng.normal(size=days)
    a = (bench + effect) / np.sqrt(252) * vol + vol * one
    b = bench / np.sqrt(252) * vol + vol * (rho * one + np.sqrt(max(1 - rho**2, 0.0)) * two)
    diffs = [difference_draw(a, b, block, [*seed, k]) for k in range(draws)]
    low, high = np.percentile(diffs, [2.5, 97.5])
    return bool(low > 0 or high < 0), float(high - low)
