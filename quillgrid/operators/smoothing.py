"""Holt-Winters on one short series: additive damped trend, optional additive season.

All parameter candidates are stepped through the series together as NumPy vectors, so a
fit is a handful of array passes: a coarse grid, then a pattern search around the best.
"""

from itertools import product

import numpy as np

_GRID = (
    (0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95),  # level
    (0.01, 0.05, 0.1, 0.2, 0.4),  # trend
    (0.01, 0.05, 0.1, 0.3),  # season
    (0.80, 0.90, 0.95, 0.98, 0.995),  # damping
)
_STEPS = np.array([0.1, 0.05, 0.05, 0.02])
_LOW = np.array([1e-3, 1e-4, 1e-4, 0.8])
_HIGH = np.array([0.999, 0.999, 0.999, 0.998])
_ROUNDS = 6


def _start(values: np.ndarray, period: int):
    """First level, slope and seasonal pattern."""
    if period:
        first, second = values[:period], values[period : 2 * period]
        slope = (second.mean() - first.mean()) / period
        level = first.mean() - slope * (period + 1) / 2
        season = first - (level + slope * np.arange(1, period + 1))
        return level, slope, season - season.mean()
    head = values[: min(len(values), 10)]
    slope = np.polyfit(np.arange(len(head)), head, 1)[0] if len(head) > 1 else 0.0
    return head.mean() - slope * (len(head) + 1) / 2, slope, np.zeros(0)


def _run(values: np.ndarray, period: int, candidates: np.ndarray):
    """Squared one-step error and final state of every candidate."""
    alpha, beta, gamma, phi = candidates.T
    start, slope, pattern = _start(values, period)
    level, trend = np.full(len(alpha), start), np.full(len(alpha), slope)
    season = np.repeat(pattern[:, None], len(alpha), axis=1)
    error = np.zeros(len(alpha))
    for t, value in enumerate(values):
        damped = phi * trend
        expected = level + damped
        if period:
            expected = expected + season[t % period]
        miss = value - expected
        error += miss * miss
        level = level + damped + alpha * miss
        trend = damped + alpha * beta * miss
        if period:
            season[t % period] += gamma * (1 - alpha) * miss
    return error, level, trend, season


def holt_winters(values, horizon: int, period: int) -> np.ndarray:
    values = np.asarray(values, dtype=float)
    period = period if period > 1 and len(values) >= 2 * period else 0
    grid = [g if period or i != 2 else g[:1] for i, g in enumerate(_GRID)]
    candidates = np.array(list(product(*grid)))
    best = candidates[np.argmin(_run(values, period, candidates)[0])]
    steps = _STEPS.copy()
    offsets = np.array(list(product((-1, 0, 1), repeat=4)))
    for _ in range(_ROUNDS):
        around = np.clip(best + offsets * steps, _LOW, _HIGH)
        best = around[np.argmin(_run(values, period, around)[0])]
        steps = steps / 2
    _, level, trend, season = _run(values, period, best[None, :])
    ahead = np.arange(1, horizon + 1)
    damping = np.cumsum(best[3] ** ahead)
    forecast = level[0] + damping * trend[0]
    if period:
        forecast = forecast + season[(len(values) + ahead - 1) % period, 0]
    return forecast
