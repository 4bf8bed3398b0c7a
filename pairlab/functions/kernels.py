"""Numerical kernels in numpy: unit-root test, imaginary error function, thresholds and state machines.

They work on one group's arrays and are called from grouped or scalar pandas functions.
"""

from __future__ import annotations

import math

import numpy as np


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, sum of squared residuals, inverse normal matrix) of y on the columns of x."""
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ (x.T @ y)
    r = y - x @ b
    return b, float(r @ r), inverse


def _design(s: np.ndarray, lags: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences, and level, lagged differences and constant, for the last ``rows`` rows."""
    d = np.diff(s)
    n = len(d)
    cols = [s[n - rows : n]] + [d[n - rows - k : n - k] for k in range(1, lags + 1)] + [np.ones(rows)]
    return d[n - rows :], np.column_stack(cols)


def _squares(s: np.ndarray, max_lag: int, rows: int) -> list[float]:
    """Sums of squared residuals with 0 to max_lag lags on the same rows, from one triangular factor of them all.

    Columns that nearly depend on each other are fitted lag by lag, in the least norm.
    """
    y, x = _design(s, max_lag, rows)
    nested = np.column_stack([x[:, -1], x[:, :-1], y])  # constant, level, lags in order, difference
    r = np.linalg.qr(nested, mode="r") if rows > nested.shape[1] else np.zeros((1, 1))
    least = np.abs(np.diag(r))[:-1] <= 1e-9 * np.sqrt((r * r).sum(axis=0))[:-1]
    if len(r) < nested.shape[1] or least.any():
        return [ols(*_design(s, lags, rows))[1] for lags in range(max_lag + 1)]
    return np.cumsum(r[::-1, -1] ** 2)[::-1][2:].tolist()


def adf(s: np.ndarray, max_lag: int | None = None) -> tuple[float, float, int]:
    """(statistic, p-value, lags) of the augmented Dickey-Fuller test with a constant.

    Lags are chosen by AIC on a common sample and the regression is then run on all rows.
    """
    n = len(s)
    if max_lag is None:
        max_lag = max(0, min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2))
    rows = n - 1 - max_lag
    best = None
    for lags, sse in enumerate(_squares(s, max_lag, rows)):
        sse = max(sse, 1e-300)
        aic = rows * (math.log(2 * math.pi * sse / rows) + 1) + 2 * (lags + 2)
        if best is None or aic < best[0]:
            best = (aic, lags)
    lags = best[1]
    y, x = _design(s, lags, n - 1 - lags)
    b, sse, inverse = ols(y, x)
    free = len(y) - x.shape[1]
    error = math.sqrt(max(sse / free * inverse[0, 0], 0.0)) if free > 0 else 0.0
    stat = b[0] / error if error > 0 else math.nan
    return float(stat), mackinnon_p(stat), lags


#: MacKinnon's response surface for one series with a constant.
_SMALL = (2.1659, 1.4412, 0.038269)
_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
_BREAK, _MOST, _LEAST = -1.61, 2.74, -18.83


def mackinnon_p(stat: float) -> float:
    """Approximate p-value of a Dickey-Fuller statistic."""
    if math.isnan(stat):
        return math.nan
    if stat > _MOST:
        return 1.0
    if stat < _LEAST:
        return 0.0
    z = sum(c * stat**i for i, c in enumerate(_SMALL if stat <= _BREAK else _LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def erfi(x: np.ndarray | float) -> np.ndarray:
    """Imaginary error function by its power series; inf where it overflows."""
    x = np.asarray(x, float)
    with np.errstate(over="ignore", invalid="ignore"):
        square = x * x
        term = x.copy()
        total = x.copy()
        for n in range(1, 1000):
            term = term * square / n
            add = term / (2 * n + 1)
            total = total + add
            if not np.any(np.abs(add) > 1e-17 * np.abs(total)):
                break
    return np.where(np.isnan(total), np.copysign(np.inf, x), total) * (2.0 / math.sqrt(math.pi))


def bertram_thresholds(sigma_eq: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The entry distance a that maximises (a - cost) over the mean cycle length; NaN if there is none.

    A null deviation (a refused fit) gives NaN; with a deviation, a cost that is negative or not finite raises.

    At the maximum erfi(u) = (a - c) 2 / sqrt(pi) exp(u^2) / (sigma_eq sqrt 2) with u = a / (sigma_eq sqrt 2);
    the difference of the sides falls through zero once above c.
    """
    sigma_eq, cost = np.broadcast_arrays(np.asarray(sigma_eq, float), np.asarray(cost, float))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        if np.any(np.isfinite(sigma_eq) & (~np.isfinite(cost) | (cost < 0))):
            raise ValueError("costs must be finite and not negative")
        root2 = sigma_eq * math.sqrt(2.0)

        def excess(a):  # scaled by exp(-u^2), which keeps it finite
            u = a / root2
            return _dawson_like(u) - (a - cost) * (2.0 / math.sqrt(math.pi)) / root2

        lo, hi = cost.astype(float).copy(), 15.0 * sigma_eq
        feasible = np.isfinite(sigma_eq) & (sigma_eq > 0) & np.isfinite(cost) & (cost >= 0) & (hi > cost)
        for _ in range(200):
            mid = (lo + hi) / 2
            up = excess(mid) > 0
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return np.where(feasible & ((lo + hi) / 2 < 14.999 * sigma_eq), (lo + hi) / 2, np.nan)


def _dawson_like(u: np.ndarray) -> np.ndarray:
    """exp(-u^2) erfi(u), by series below 5 and by its asymptotic expansion above."""
    small = np.minimum(u, 5.0)
    near = np.exp(-small * small) * erfi(small)
    big = np.maximum(u, 5.0)
    total, term = np.ones_like(big), np.ones_like(big)
    for k in range(1, 12):
        term = term * (2 * k - 1) / (2 * big * big)
        total = total + term
    return np.where(u < 5.0, near, total / (big * math.sqrt(math.pi)))


def cycle_length(a, kappa, sigma_eq) -> np.ndarray:
    """Mean length of a trade cycle that enters at a; inf for a <= 0 or bad parameters."""
    a, kappa, sigma_eq = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, kappa, sigma_eq)))
    ok = (a > 0) & (kappa > 0) & (sigma_eq > 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(ok, math.pi / (2 * kappa) * erfi(np.where(ok, a / (sigma_eq * math.sqrt(2.0)), 0.0)), np.inf)


def return_per_time(a, cost, kappa, sigma_eq) -> np.ndarray:
    """(a - cost) over the cycle length; 0 for a <= cost."""
    a, cost = np.broadcast_arrays(np.asarray(a, float), np.asarray(cost, float))
    length = cycle_length(a, kappa, sigma_eq)
    return np.where((a > cost) & np.isfinite(length), (a - cost) / length, 0.0)


def hurst(x: np.ndarray, max_lag: int = 100) -> float:
    """Slope of ln(std of differences at lag tau) on ln(tau), tau from 2; NaN under 20 rows or 4 usable lags."""
    n = len(x)
    if n < 20:
        return math.nan
    lags = np.arange(2, min(max_lag, n // 2) + 1)

    def exact(t: int) -> float:
        d = x[t:] - x[:-t]
        d = d - d.sum() / len(d)
        return float(d @ d) / len(d)

    # All lags at once: squares of differences from sums of squares and the series' products with itself, by its Fourier transform.
    moved = x - x[0]
    moved = moved - moved.mean()
    size = 1 << (n + len(lags) + 1).bit_length()
    products = np.fft.irfft(np.abs(np.fft.rfft(moved, size)) ** 2, size)[lags]
    sums, squares = (np.r_[0.0, np.cumsum(v)] for v in (moved, moved * moved))
    count = n - lags
    spread = (squares[n] - squares[lags] + squares[count] - 2 * products) / count - ((sums[n] - sums[lags] - sums[count]) / count) ** 2
    for i in np.flatnonzero(~(spread > 1e-4 * squares[n] / n)):  # too small beside the series to be a difference of sums
        spread[i] = exact(int(lags[i]))
    kept = spread > 0
    if kept.sum() < 4:
        return math.nan
    t, s = np.log(lags[kept]), np.log(spread[kept]) / 2
    t = t - t.mean()
    return float(t @ s / (t @ t))


def half_life(s: np.ndarray) -> float:
    """ln(1/2) / ln(phi) of an AR(1) fit; inf for phi >= 1, NaN for phi <= 0 or under 3 rows."""
    if len(s) < 3:
        return math.nan
    x, y = s[:-1] - s[:-1].mean(), s[1:] - s[1:].mean()
    var = float(x @ x)
    phi = float(x @ y) / var if var > 0 else math.nan
    return math.nan if math.isnan(phi) or phi <= 0 else math.inf if phi >= 1 else -math.log(2.0) / math.log(phi)


def rolling_machine(z: np.ndarray, entry: float, exit_: float, stop: float, max_holding: int, side: int = 0, bars: int = 0) -> tuple[np.ndarray, np.ndarray, list]:
    """(position, held, reason) at each bar: enter beyond entry, leave by stop, then reversion, then time.

    A NaN carries the state. The bar of an exit is flat and never enters anew. ``side`` and ``bars`` are the state before the first bar.
    """
    position, held, reason = np.zeros(len(z), np.int8), np.zeros(len(z), np.int32), [None] * len(z)
    for i, v in enumerate(z.tolist()):
        if v == v:
            if side == 0:
                side = -1 if v > entry else 1 if v < -entry else 0
                bars = 1 if side else 0
            else:
                toward = v * side  # below zero while the spread is away on the entry's side
                why = "stop" if toward <= -stop else "mean_revert" if toward >= -exit_ else "time" if bars >= max_holding else None
                if why:
                    reason[i], side, bars = why, 0, 0
                else:
                    bars += 1
        position[i], held[i] = side, bars
    return position, held, reason


def machine_state(number: int, max_holding: int) -> tuple[int, int]:
    """(side, bars) of a numbered state: 0 is flat, then long for 1 to max_holding bars, then short."""
    return (0, 0) if number == 0 else (1, number) if number <= max_holding else (-1, number - max_holding)


def rolling_transitions(z: np.ndarray, entry: float, exit_: float, stop: float, max_holding: int) -> np.ndarray:
    """The numbered state after z of rolling_machine, for each numbered state before it.

    All states run side by side until they have met, at the latest when the longest holding is over and all were flat at once.
    """
    each = np.arange(1, max_holding + 1)
    side, bars = np.r_[0, np.ones_like(each), -np.ones_like(each)], np.r_[0, each, each]
    seen = z[~np.isnan(z)]
    for i, v in enumerate(seen.tolist()):
        if (side == side[0]).all() and (bars == bars[0]).all():
            position, held, _ = rolling_machine(seen[i:], entry, exit_, stop, max_holding, int(side[0]), int(bars[0]))
            side, bars = np.full_like(side, position[-1]), np.full_like(bars, held[-1])
            break
        toward = v * side
        new = -1 if v > entry else 1 if v < -entry else 0
        flat = side == 0
        out = (toward <= -stop) | (toward >= -exit_) | (bars >= max_holding)
        side, bars = np.where(flat, new, np.where(out, 0, side)), np.where(flat, abs(new), np.where(out, 0, bars + 1))
    return np.where(side == 0, 0, np.where(side > 0, bars, bars + max_holding)).astype(np.int32)


def ou_machine(z: np.ndarray, entry: float, hard_stop: float | None, max_holding: int) -> tuple[np.ndarray, np.ndarray, list]:
    """(position, held, reason): enter at or beyond the threshold, leave by hard stop, at the crossing of zero, or by time.

    Time counts finite bars since entry; held is 0 on the entry bar and that count plus 1 after, so 1 on
    NaN bars right after entry.
    """
    position, held, reason = np.zeros(len(z), np.int8), np.zeros(len(z), np.int32), [None] * len(z)
    side = since = shown = 0
    for i, v in enumerate(z.tolist()):
        if v == v:
            if side == 0:
                side = -1 if v >= entry else 1 if v <= -entry else 0
                since = shown = 0
                position[i], held[i] = side, 0
                shown = 1 if side else 0
                continue
            else:
                since += 1
                why = "z_stop" if hard_stop is not None and v * side <= -hard_stop else "mean_revert" if v * side >= 0 else "time_stop" if since >= max_holding else None
                if why:
                    reason[i], side, since, shown = why, 0, 0, 0
                else:
                    shown = since + 1
        position[i], held[i] = side, shown
    return position, held, reason
