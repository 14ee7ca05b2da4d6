import numpy as np
import pytest

from lodestar.functions import arimax, seasonal


@pytest.mark.parametrize("p", [7, 12, 24])
def test_period_and_decomposition(p):
    n = 10 * p + 3
    t = np.arange(n)
    y = 100 + 0.3 * t + 10 * np.sin(2 * np.pi * t / p) + np.random.default_rng(p).normal(0, 0.5, n)
    y[p] += 80
    assert seasonal.period_of(y) == p
    d = seasonal.decompose(y)
    assert d.period == p and np.allclose(d.trend + d.seasonal + d.residual, y)
    ahead = np.arange(n, n + p)
    assert np.abs(d.forecast(p) - (100 + 0.3 * ahead + 10 * np.sin(2 * np.pi * ahead / p))).max() < 6


def test_noise_has_no_period():
    rng = np.random.default_rng(1)
    assert sum(seasonal.period_of(rng.normal(size=200)) > 0 for _ in range(100)) <= 3


def test_level_shift_is_a_break_and_a_spike_is_none():
    y = np.concatenate([np.zeros(60), np.full(60, 10.0)]) + np.random.default_rng(2).normal(0, 0.3, 120)
    assert any(abs(c - 60) <= 1 for c in seasonal.changepoints(y, 3))
    flat = np.random.default_rng(3).normal(0, 1, 120)
    flat[50] = 500
    assert 50 not in seasonal.changepoints(flat, 3)


def test_filled():
    assert seasonal.filled(np.array([np.nan, 2, np.nan, 3])).tolist() == [2, 2, 2, 3]
    assert seasonal.filled(np.array([np.nan, np.nan])).tolist() == [0, 0]


def test_arimax_recovers_parameters_and_covers():
    rng = np.random.default_rng(20261008)
    beta, inside, total = [], 0, 0
    for _ in range(25):
        n, h = 500, 6
        x, z = rng.normal(size=n + h), rng.normal(size=n + h)
        e = np.zeros(n + h)
        for i in range(1, n + h):
            e[i] = 0.6 * e[i - 1] + z[i] + 0.3 * z[i - 1]
        y = 1 + 2.5 * x + e
        m = arimax.fit(y[:n], x[:n], (1, 0, 1))
        beta.append(m.coef[1])
        _, low, high = m.forecast(h, x[n:])
        inside += int(((y[n:] >= low) & (y[n:] <= high)).sum())
        total += h
    assert abs(np.mean(beta) - 2.5) < 0.02 and 0.88 <= inside / total <= 1.0


def test_integrated_forecast_continues_the_line():
    y = np.arange(50.0) * 2 + 5
    mean, low, high = arimax.fit(y, None, (0, 1, 0)).forecast(3)
    assert np.allclose(mean, y[-1]) or np.allclose(np.diff(mean), 2)
    with pytest.raises(ValueError):
        arimax.fit(np.arange(3.0), None, (1, 1, 1))


def test_partial_autocorrelation_of_an_ar1():
    r = 0.7 ** np.arange(6)
    assert arimax.partial_autocorrelation(r) == pytest.approx([1, 0.7, 0, 0, 0, 0], abs=1e-12)
