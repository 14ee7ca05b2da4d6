"""Regression with ARIMA errors for one series, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def difference(y: np.ndarray, d: int) -> np.ndarray:
    return np.diff(y, n=d) if d else np.asarray(y, dtype=float)


def innovations(y: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """One-step errors after the first p points, with earlier errors taken as 0."""
    p, q = len(phi), len(theta)
    base = np.array(y[p:], dtype=float)
    for i in range(p):
        base -= phi[i] * y[p - 1 - i : len(y) - 1 - i]
    if not q:
        return base
    th, e = theta.tolist(), [0.0] * q
    for b in base.tolist():
        for j in range(q):
            b -= th[j] * e[-1 - j]
        e.append(b)
    return np.array(e[q:])


def simplex(cost, start: np.ndarray, step: float, most: int = 2000, tol: float = 1e-10) -> np.ndarray:
    """Nelder-Mead minimum."""
    n = len(start)
    pts = np.vstack([start, start + step * np.eye(n)])
    val = np.array([cost(v) for v in pts])
    for _ in range(most):
        order = np.argsort(val, kind="stable")
        pts, val = pts[order], val[order]
        if abs(val[-1] - val[0]) <= tol * (abs(val[0]) + tol) and np.abs(pts[1:] - pts[0]).max() <= 1e-8:
            break
        centre = pts[:-1].mean(axis=0)

        def along(k, centre=centre, worst=pts[-1]):
            v = centre + k * (worst - centre)
            return v, cost(v)

        v, c = along(-1.0)
        if c < val[0]:
            v2, c2 = along(-2.0)
            v, c = (v2, c2) if c2 < c else (v, c)
        elif c >= val[-2]:
            v, c = along(-0.5 if c < val[-1] else 0.5)
            if c >= val[-1]:
                pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
                val[1:] = [cost(v) for v in pts[1:]]
                continue
        pts[-1], val[-1] = v, c
    return pts[np.argmin(val)]


def _fit_arma(y: np.ndarray, p: int, q: int, start: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    if not p + q:
        return np.zeros(0), np.zeros(0)

    def cost(par):
        if np.abs(par[:p]).sum() >= 0.999:
            return np.inf
        with np.errstate(over="ignore", invalid="ignore"):
            s = float((innovations(y, par[:p], par[p:]) ** 2).sum())
        return s if np.isfinite(s) else np.inf

    best = simplex(cost, start, step)
    return best[:p], best[p:]


@dataclass
class Arimax:
    order: tuple[int, int, int]
    coef: np.ndarray
    phi: np.ndarray
    theta: np.ndarray
    sigma2: float
    errors: np.ndarray
    residuals: np.ndarray

    def forecast(self, h: int, x: np.ndarray | None = None, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean, lower, upper). The bounds widen as the differenced process does, whatever d."""
        p, d, _ = self.order
        alpha = alpha if 0 < alpha < 1 else 0.05
        w = difference(self.errors, d)
        e = [0.0] * p + self.residuals.tolist()
        past, out = w.tolist(), []
        for _ in range(h):
            v = sum(f * past[-1 - i] for i, f in enumerate(self.phi)) + sum(t * (e[-1 - j] if len(e) > j else 0.0) for j, t in enumerate(self.theta))
            past.append(v)
            e.append(0.0)
            out.append(v)
        level = np.array(out)
        for k in range(d - 1, -1, -1):
            level = difference(self.errors, k)[-1] + np.cumsum(level)
        mean = level + self.coef[0]
        if len(self.coef) > 1:
            mean = mean + np.asarray(x, dtype=float).reshape(h, -1) @ self.coef[1:]
        psi = [1.0]
        for k in range(1, h):
            psi.append((self.theta[k - 1] if k <= len(self.theta) else 0.0) + sum(self.phi[i] * psi[k - 1 - i] for i in range(min(k, len(self.phi)))))
        half = normal_quantile(1 - alpha / 2) * np.sqrt(self.sigma2 * np.cumsum(np.square(psi)))
        return mean, mean - half, mean + half


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def fit(y: np.ndarray, x: np.ndarray | None, order: tuple[int, int, int], passes: int = 4) -> Arimax:
    """Least squares, then ARMA errors by conditional sum of squares, then feasible GLS passes."""
    p, d, q = order
    y = np.asarray(y, dtype=float)
    n = len(y)
    if min(order) < 0:
        raise ValueError("an order may not be negative")
    if n <= d + 2 or n - d <= p + q + 2:
        raise ValueError("the series is too short for this order")
    design = np.ones((n, 1)) if x is None else np.column_stack([np.ones(n), np.asarray(x, dtype=float).reshape(n, -1)])
    coef = np.linalg.lstsq(design, y, rcond=None)[0]
    errors = y - design @ coef
    start = np.concatenate([np.full(p, 0.1), np.zeros(q)])
    phi, theta = _fit_arma(difference(errors, d), p, q, start, 0.10)
    skip = 1 if d else 0
    if p + q and design.shape[1] > skip:
        for _ in range(passes):
            white = [innovations(difference(c, d), phi, theta) for c in (y, *design.T[skip:])]
            if len(white[0]) <= len(white) - 1:
                break
            new = coef.copy()
            new[skip:] = np.linalg.lstsq(np.column_stack(white[1:]), white[0], rcond=None)[0]
            move, scale = np.abs(new - coef).max(), np.abs(new).max()
            coef, errors = new, y - design @ new
            phi, theta = _fit_arma(difference(errors, d), p, q, np.concatenate([phi, theta]), 0.01)
            if move <= 1e-8 * (1 + scale):
                break
    residuals = innovations(difference(errors, d), phi, theta)
    return Arimax(order, coef, phi, theta, float(np.var(residuals, ddof=1)) if len(residuals) > 1 else 0.0, errors, residuals)


def partial_autocorrelation(r: np.ndarray) -> np.ndarray:
    """Durbin-Levinson over autocorrelations r[0..k]; the result starts with 1 at lag 0."""
    out, phi = [1.0], np.zeros(0)
    for k in range(1, len(r)):
        below = 1 - float(phi @ r[1:k]) if k > 1 else 1.0
        a = (r[k] - float(phi @ r[k - 1 : 0 : -1])) / below if below else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        out.append(float(a))
    return np.array(out)
