"""Seasonal structure of one series, in numpy: period, Fourier season, breaks, decomposition."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_MAD_TO_SIGMA = 0.6744897501960817
_REACH, _LIMIT, _SHORTEST_LINE, _LEAST_POINTS = 3, 4.0, 4, 28


def filled(x: np.ndarray) -> np.ndarray:
    """Missing values take the last one before; leading ones the first; none at all gives zeros."""
    x = np.array(x, dtype=float)
    there = ~np.isnan(x)
    if not there.any():
        return np.zeros_like(x)
    at = np.maximum.accumulate(np.where(there, np.arange(len(x)), -1))
    return x[np.where(at < 0, np.argmax(there), at)]


def robust_sigma(y: np.ndarray, lag: int = 1) -> float:
    d = y[lag:] - y[:-lag]
    return float(np.median(np.abs(d - np.median(d)))) / _MAD_TO_SIGMA / np.sqrt(2)


def _clip_to_neighbours(v: np.ndarray, sigma: float) -> np.ndarray:
    """Points farther than four sigma from the median of the seven around them become it.

    At the ends the window slides inward.
    """
    w = min(2 * _REACH + 1, len(v))
    low = np.clip(np.arange(len(v)) - _REACH, 0, len(v) - w)
    mid = np.median(np.lib.stride_tricks.sliding_window_view(v, w), axis=-1)[low]
    return np.where(np.abs(v - mid) > _LIMIT * sigma, mid, v)


def hampel(v: np.ndarray) -> np.ndarray:
    if len(v) < 2 * _REACH + 2:
        return v
    sigma = robust_sigma(v)
    return _clip_to_neighbours(v, sigma) if sigma > 0 else v


def phase_hampel(v: np.ndarray, period: int, sigma: float) -> np.ndarray:
    """The same with neighbours from the same phase of adjacent cycles."""
    if len(v) < 3 * period or not sigma > 0:
        return v
    out = v.copy()
    for p in range(period):
        out[p::period] = _clip_to_neighbours(v[p::period], sigma)
    return out


@dataclass
class Fourier:
    period: int = 0
    mean: float = 0.0
    cos: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sin: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def at(self, t) -> np.ndarray:
        t = np.asarray(t)
        if self.period < 2 or not len(self.cos):
            return np.zeros(t.shape)
        turn = 2 * np.pi * np.outer(t % self.period, np.arange(1, len(self.cos) + 1)) / self.period
        return (np.cos(turn) @ self.cos + np.sin(turn) @ self.sin).reshape(t.shape)

    def amplitude(self, k: int) -> float:
        return float(np.hypot(self.cos[k - 1], self.sin[k - 1])) if 1 <= k <= len(self.cos) else 0.0


def fit_fourier(x: np.ndarray, period: int, harmonics: int) -> Fourier:
    """Least squares on the mean and up to period / 2 harmonics, from sums by phase."""
    h = min(harmonics, period // 2)
    phase = np.arange(len(x)) % period
    count = np.bincount(phase, minlength=period).astype(float)
    total = np.bincount(phase, weights=x, minlength=period)
    turn = 2 * np.pi * np.outer(np.arange(period), np.arange(1, h + 1)) / period
    sines = np.sin(turn)
    nyquist = 2 * h == period
    design = np.concatenate([np.ones((period, 1)), np.cos(turn), sines[:, : h - 1] if nyquist else sines], axis=1)
    coef = np.linalg.lstsq((design * count[:, None]).T @ design, design.T @ total, rcond=None)[0]
    sin = np.append(coef[1 + h :], 0.0) if nyquist else coef[1 + h :]
    return Fourier(period, float(coef[0]), coef[1 : 1 + h], sin)


class _Sums:
    """Prefix sums, so the squared error of a line over any stretch costs O(1)."""

    def __init__(self, y: np.ndarray):
        t = np.arange(len(y), dtype=float)
        y = y - y.mean()
        self.parts = [np.concatenate([[0.0], np.cumsum(v)]) for v in (y, y * t, y * y)]

    def error(self, lo, hi):
        """Of the least-squares line over lo..hi-1, for arrays of bounds."""
        lo, hi = np.asarray(lo), np.asarray(hi)
        n = (hi - lo).astype(float)
        sy, sty, syy = (p[hi] - p[lo] for p in self.parts)
        mid = (lo + hi - 1) / 2
        stt = n * (n * n - 1) / 12
        return np.maximum(syy - sy * sy / n - np.where(stt > 0, (sty - mid * sy) ** 2 / np.where(stt > 0, stt, 1), 0), 0)


def changepoints(x: np.ndarray, most: int) -> list[int]:
    """Starts of new straight lines: greedy splits that each earn their price."""
    x = filled(x)
    n = len(x)
    if n < 2 * _SHORTEST_LINE or most < 1:
        return []
    sigma = robust_sigma(x)
    x = hampel(x)
    price = max(3 * sigma * sigma * np.log(n), 1e-9 * (1 + float(x @ x)))
    sums, cuts = _Sums(x), [0, n]
    for _ in range(most):
        best = (price, -1)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = np.arange(lo + _SHORTEST_LINE, hi - _SHORTEST_LINE + 1)
            if len(at):
                gain = sums.error(lo, hi) - sums.error(np.full_like(at, lo), at) - sums.error(at, np.full_like(at, hi))
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(at[k]))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    return cuts[1:-1]


def _lines(y: np.ndarray, cuts: list[int]) -> list[tuple[int, float, float]]:
    """(start, value at start, slope) of the least-squares line of each stretch."""
    out = []
    for lo, hi in zip([0, *cuts], [*cuts, len(y)], strict=True):
        t = np.arange(hi - lo, dtype=float)
        dev = t - t.mean()
        slope = float(dev @ y[lo:hi] / (dev @ dev)) if hi - lo > 1 else 0.0
        out.append((lo, float(y[lo:hi].mean() - slope * t.mean()), slope))
    return out


def _draw(lines: list[tuple[int, float, float]], n: int) -> np.ndarray:
    out = np.empty(n)
    for k, (lo, a, b) in enumerate(lines):
        hi = lines[k + 1][0] if k + 1 < len(lines) else n
        out[lo:hi] = a + b * np.arange(hi - lo)
    return out


def period_of(x: np.ndarray, longest: int = 0) -> int:
    """The season's length: the highest autocorrelation peak of the cleaned differences, or 0."""
    x = filled(x)
    if len(x) < _LEAST_POINTS:
        return 0
    d = hampel(np.diff(x))
    m = len(d)
    d = d - d.mean()
    var = float(d @ d)
    top = min(m // 2, longest) if longest > 0 else m // 2
    if var == 0 or top < 2:
        return 0
    size = 1 << (2 * m - 1).bit_length()
    f = np.fft.rfft(d, size)
    r = np.fft.irfft(f * np.conj(f), size)[: top + 2] / var
    if top + 1 >= m:
        r[m:] = 0.0
    lag = np.arange(2, top + 1)
    peak = lag[(r[lag] >= r[lag - 1]) & (r[lag] >= r[lag + 1])]
    bar = max(0.2, np.sqrt(2 * np.log((top - 1) / 0.01)) * np.sqrt(1.5 / m))
    peak = peak[r[peak] > bar]
    if not len(peak):
        return 0
    best = int(peak[np.argmax(r[peak])])
    rest = hampel(x - _draw(_lines(x, []), len(x)))
    t = np.arange(len(x))
    score = {}
    for p in range(best - 1, best + 2):
        if 2 <= p <= top:
            four = fit_fourier(rest, p, 3)
            score[p] = float(((rest - four.mean - four.at(t)) ** 2).sum())
    return min(score, key=lambda p: (score[p], p))


@dataclass
class Decomposition:
    trend: np.ndarray
    seasonal: np.ndarray
    residual: np.ndarray
    period: int
    breaks: list[int]
    lines: list[tuple[int, float, float]]
    season: Fourier

    def forecast(self, h: int) -> np.ndarray:
        n = len(self.trend)
        t = np.arange(n, n + h)
        lo, a, b = self.lines[-1]
        return a + b * (t - lo) + self.season.mean + self.season.at(t)


def decompose(x: np.ndarray, period: int = 0, harmonics: int = 3, breaks: int = 3) -> Decomposition:
    """Trend of straight lines, Fourier season and residual, which add up to the filled series."""
    x = np.asarray(x, dtype=float)
    if len(x) < 4:
        raise ValueError("a series of fewer than 4 points has no decomposition")
    if np.isnan(x).all():
        raise ValueError("a series without values has no decomposition")
    y, n = filled(x), len(x)
    t = np.arange(n)
    period = period or period_of(y)
    period = 0 if period < 2 or 2 * period > n else period
    season = Fourier()
    if period:
        d = y[period:] - y[:-period]
        mid = float(np.median(d))
        left = y - mid / period * t
        sigma = float(np.median(np.abs(d - mid))) / _MAD_TO_SIGMA / np.sqrt(2)
        season = fit_fourier(phase_hampel(left - left.mean(), period, sigma), period, harmonics)
    flat = y - season.at(t)
    cuts = changepoints(flat, breaks) if breaks > 0 else []
    lines = _lines(flat, cuts)
    trend = _draw(lines, n)
    if period:
        left = y - trend
        season = fit_fourier(phase_hampel(left, period, robust_sigma(left, period)), period, harmonics)
    seasonal = season.at(t)
    trend = trend + season.mean
    return Decomposition(trend, seasonal, y - trend - seasonal, period, cuts, lines, season)
