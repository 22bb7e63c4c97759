"""Boosted trees for the probability of a rise, over many training windows at once; imported by executors, so free of Spark.

Each window has its own trees: all windows grow the same level at the same time, and the
splits of a level come from running sums of gradients in the order of each feature.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from tidemark.functions.forecast import ASSETS, FEATURES, LAST, TOGETHER, Windows

# Fixed values of the booster: trees, levels, step, least rows and least curvature of a leaf.
TREES, LEVELS, STEP, LEAST_ROWS, LEAST_CURVE = 50, 3, 0.1, 20, 1e-3
#: Windows whose sums a processor's cache holds.
CACHED = 8
BOOSTED = "symbol string, i long, date date, up double, actual double"


def rise_odds(x: np.ndarray, rises: np.ndarray, used: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Log odds of a rise at each window's ``point`` (window, feature).

    ``x`` is (window, row, feature), ``rises`` 0 or 1 and ``used`` the mask of rows in use;
    each window holds both classes.  A split lies midway between two neighbouring values of
    the window.  The greatest gain wins, then the first feature, then the lowest split;
    without a positive gain a node stays a leaf.
    """
    windows, rows, _ = x.shape
    by_feature = np.where(used[:, None], x.transpose(0, 2, 1), np.inf)
    order = by_feature.argsort(axis=2, kind="stable")
    values = np.take_along_axis(by_feature, order, axis=2)
    low, high = values[:, :, :-1], values[:, :, 1:]
    apart = (low < high) & np.isfinite(high)
    middle = np.where(apart, low, 0.0) / 2 + np.where(apart, high, 0.0) / 2
    flat = (np.arange(windows)[:, None, None] * rows + order)[:, :, :-1]
    every = np.arange(windows)

    share = (rises * used).sum(axis=1) / used.sum(axis=1)
    at_point = np.log(share / (1 - share))
    odds = np.repeat(at_point[:, None], rows, axis=1)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        slope, curve = (p - rises) * used, p * (1 - p) * used
        sorted_by = [v.ravel()[flat] for v in (slope, curve, used.astype(float))]
        node, point_node = np.zeros((windows, rows), np.int8), np.zeros(windows, np.int8)
        # Running sums of each node of the level; a right branch has its parent's less those of the left one.
        sums = [[np.cumsum(v, axis=2) for v in sorted_by]]
        for level in range(LEVELS):
            right, point_right = np.zeros_like(node), np.zeros_like(point_node)
            for k, left in enumerate(sums):
                here = (node == k) & used
                total = [(v * here).sum(axis=1)[:, None, None] for v in (slope, curve, 1.0)]
                other = [t - v for t, v in zip(total, left, strict=True)]
                fits = apart & (np.minimum(left[2], other[2]) > LEAST_ROWS - 0.5) & (np.minimum(left[1], other[1]) >= LEAST_CURVE)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(fits, left[0] ** 2 / left[1] + other[0] ** 2 / other[1], -np.inf)
                cell = gains.reshape(windows, -1).argmax(axis=1)
                feature, cut = np.divmod(cell, rows - 1)
                gain = gains[every, feature, cut] - total[0][:, 0, 0] ** 2 / np.maximum(total[1][:, 0, 0], LEAST_CURVE)
                split, middles = gain > 1e-12, middle[every, feature, cut]
                right |= here & split[:, None] & (by_feature[every, feature] > middles[:, None])
                point_right |= (point_node == k) & split & (point[every, feature] > middles)
            node, point_node = node * 2 + right, point_node * 2 + point_right
            if level + 1 < LEVELS:
                places = node.ravel()[flat]
                lefts = [[np.cumsum(v * (places == 2 * k), axis=2) for v in sorted_by] for k in range(len(sums))]
                sums = [part for left, whole in zip(lefts, sums, strict=True) for part in (left, [w - v for w, v in zip(whole, left, strict=True)])]
        leaves = np.zeros((windows, 1 << LEVELS))
        for k in range(1 << LEVELS):
            here = node == k
            total = (curve * here).sum(axis=1)
            leaves[:, k] = np.where(total > 0, -STEP * (slope * here).sum(axis=1) / np.where(total > 0, total, 1.0), 0.0)
        odds += np.take_along_axis(leaves, node, axis=1)
        at_point += leaves[every, point_node]
    return at_point


def parts() -> int:
    """Groups of cut points that a symbol's LAST rows make."""
    return -(-LAST // TOGETHER)


def boosted_walk(frame: pd.DataFrame, part: int, asset: str = "equity") -> pd.DataFrame:
    """Probabilities of a rise at one part of the last LAST rows of a symbol (symbol, i, date, FEATURES, target).

    Each is from trees of its own over the window of rows before it.  Rows without a target
    take no part; windows of one class give no forecast, nor do symbols of too few rows.
    """
    window, least = ASSETS[asset][:2]
    frame = frame[frame["target"].notna()].sort_values("i").reset_index(drop=True)
    x, y = frame[list(FEATURES)].to_numpy(float), frame["target"].to_numpy(float)
    cuts = np.arange(max(least, len(frame) - LAST), len(frame))[part * TOGETHER : (part + 1) * TOGETHER]
    ups = np.r_[0, np.cumsum(y > 0)]
    first = np.maximum(cuts - window, 0)
    mixed = (ups[cuts] > ups[first]) & (ups[cuts] - ups[first] < cuts - first)
    cuts, first = cuts[mixed], first[mixed]
    if not len(cuts):
        return pd.DataFrame(columns=[c.split()[0] for c in BOOSTED.split(", ")], dtype=object)
    fit = Windows(x, y, first, cuts)
    rises, point = (fit.y > 0).astype(float), fit.scaled(x[cuts][:, None])[:, 0, 1:]
    few = [slice(k, k + CACHED) for k in range(0, len(cuts), CACHED)]
    odds = np.concatenate([rise_odds(fit.x[k, :, 1:], rises[k], fit.used[k], point[k]) for k in few])
    return pd.DataFrame({"symbol": frame["symbol"].to_numpy()[cuts], "i": frame["i"].to_numpy()[cuts], "date": frame["date"].to_numpy()[cuts], "up": 1 / (1 + np.exp(-odds)), "actual": y[cuts]})
