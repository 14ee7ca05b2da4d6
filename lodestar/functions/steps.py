"""One step kernel for each recurrence: ``state, reading -> state, output``.

A kernel is a class with ``start()`` and ``step(state, row)``; ``state`` is a flat tuple
of numbers, so batch folds, streaming state and tests share it. Time is an argument in
integer nanoseconds, never the clock.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

INF = float("inf")


def _finite(x) -> bool:
    return x is not None and math.isfinite(x)


@dataclass(frozen=True)
class Ewma:
    """Moves by ``alpha`` of the distance; the first value starts it."""

    alpha: float
    fields = "v double, n long"
    out = "ewma double"

    @classmethod
    def half_life(cls, steps: float) -> Ewma:
        return cls(1 - 2 ** (-1 / steps))

    def start(self):
        return (0.0, 0)

    def step(self, s, x, at=None):
        v, n = s
        if not _finite(x):
            return s, ((v,) if n else None)
        v = x if n == 0 else v + self.alpha * (x - v)
        return (v, n + 1), (v,)


@dataclass(frozen=True)
class EwmaChart:
    """EWMA against control limits around ``target`` that widen to their steady state."""

    target: float
    sigma: float
    lam: float = 0.2
    wide: float = 3.0
    fields = "z double, t long"
    out = "z double, lower double, upper double, signal string"

    def start(self):
        return (self.target, 0)

    def step(self, s, x, at=None):
        z, t = s
        if not _finite(x):
            return s, None
        z, t = self.lam * x + (1 - self.lam) * z, t + 1
        w = self.wide * self.sigma * math.sqrt(self.lam / (2 - self.lam) * -math.expm1(2 * t * math.log1p(-self.lam)) if self.lam < 1 else 1.0)
        signal = "up" if z > self.target + w else "down" if z < self.target - w else "none"
        return (z, t), (z, self.target - w, self.target + w, signal)


@dataclass(frozen=True)
class DecayedRate:
    """Exponentially decayed rate of a counter over ``window_ns``; a fall starts anew."""

    window_ns: int
    fields = "last double, at long, avg double, seen long"
    out = "rate double"

    def start(self):
        return (0.0, 0, 0.0, 0)

    def step(self, s, x, at):
        last, was, avg, seen = s
        if not _finite(x) or x < 0:
            return s, None
        if not seen:
            return (x, at, avg, 1), None
        if at <= was:
            return s, None
        if x < last:
            return (x, at, avg, seen), ((avg,) if seen > 1 else None)
        r = (x - last) / ((at - was) / 1e9)
        avg = r if seen == 1 else avg + (r - avg) * -math.expm1(-(at - was) / self.window_ns)
        return (x, at, avg, 2), (avg,)


@dataclass(frozen=True)
class Hysteresis:
    """On from ``on``, off from ``off``; a change within ``dwell_ns`` of the last is held."""

    on: float
    off: float
    low: bool = False
    dwell_ns: int = 0
    fields = "active long, since long, changes long, held long, last long, seen long"
    out = "active boolean, transitions long, held long"

    def start(self):
        return (0, 0, 0, 0, 0, 0)

    def step(self, s, x, at):
        active, since, changes, held, last, seen = s
        if not _finite(x) or (seen and at <= last):
            return s, None
        want = active
        if (x <= self.on) if self.low else (x >= self.on):
            want = 1
        elif (x >= self.off) if self.low else (x <= self.off):
            want = 0
        if not seen:
            since = at
        if want != active:
            if changes > 0 and at - since < self.dwell_ns:
                held += 1
            else:
                active, since, changes = want, at, changes + 1
        return (active, since, changes, held, at, 1), (bool(active), changes, held)


@dataclass(frozen=True)
class Slew:
    """Follows a value no faster than ``rise`` and ``fall`` a second."""

    rise: float
    fall: float
    fields = "out double, last long, seen long"
    out = "slewed double"

    def start(self):
        return (0.0, 0, 0)

    def step(self, s, x, at):
        out, last, seen = s
        if not _finite(x) or (seen and at <= last):
            return s, None
        if seen:
            dt = (at - last) / 1e9
            x = min(max(x, out - self.fall * dt), out + self.rise * dt)
        return (x, at, 1), (x,)


@dataclass(frozen=True)
class Bucket:
    """Token bucket in integer nanoseconds of debt: ``per_ns`` for a token, ``burst`` tokens."""

    per_ns: int
    burst: int
    fields = "debt long, last long, seen long"
    out = "allowed boolean"

    def start(self):
        return (0, 0, 0)

    def step(self, s, n, at):
        debt, last, seen = s
        if seen:
            at = max(at, last)
            debt = max(debt - (at - last), 0)
        n = 1 if n is None else int(n)
        if n > self.burst or debt > (self.burst - n) * self.per_ns:
            return (debt, at, 1), (False,)
        return (debt + n * self.per_ns, at, 1), (True,)


@dataclass(frozen=True)
class Quota:
    """``limit`` units in each aligned window of ``length_ns``; a request is met whole or not at all."""

    limit: int
    length_ns: int
    origin_ns: int = 0
    fields = "k long, used long, last long, seen long"
    out = "allowed boolean, remaining long"

    def start(self):
        return (0, 0, 0, 0)

    def step(self, s, n, at):
        k, used, last, seen = s
        at = max(at, last) if seen else at
        now = (at - self.origin_ns) // self.length_ns
        if not seen or now != k:
            k, used = now, 0
        n = 1 if n is None else int(n)
        ok = 0 <= n <= self.limit - used
        used += n if ok else 0
        return (k, used, at, 1), (ok, self.limit - used)


@dataclass(frozen=True)
class Cooldown:
    """Allowed once ``period_ns`` have gone since the last that was; time is clamped before."""

    period_ns: int
    fields = "last long, seen long"
    out = "allowed boolean"

    def start(self):
        return (0, 0)

    def step(self, s, x, at):
        last, seen = s
        if seen and at - last < self.period_ns:
            return s, (False,)
        return (at, 1), (True,)


@dataclass(frozen=True)
class Breaker:
    """Circuit breaker over a log of ``allow`` (x is None) and results (x is 1 or 0).

    Opens after ``failures`` in a row; after ``wait_ns`` lets ``probes`` through, and
    closes when as many succeed. Results of calls it did not let through are ignored.
    """

    failures: int
    wait_ns: int
    probes: int = 1
    fields = "state long, since long, failed long, admitted long, pending long, succeeded long, last long"
    out = "state string, allowed boolean"
    names = ("closed", "open", "half-open")

    def start(self):
        return (0, 0, 0, 0, 0, 0, 0)

    def step(self, s, x, at):
        state, since, failed, admitted, pending, won, last = s
        at = max(at, last)
        if state == 1 and at - since >= self.wait_ns:
            state, since, admitted, pending, won = 2, at, 0, 0, 0
        allowed = None
        if not _finite(x):
            allowed = state == 0 or (state == 2 and admitted < self.probes)
            if allowed and state == 2:
                admitted, pending = admitted + 1, pending + 1
        elif state == 0:
            failed = 0 if x else failed + 1
            if failed >= self.failures:
                state, since, failed = 1, at, 0
        elif state == 2 and pending > 0:
            pending -= 1
            if not x:
                state, since = 1, at
            else:
                won += 1
                if won >= self.probes:
                    state, since, failed = 0, at, 0
        return (state, since, failed, admitted, pending, won, at), (self.names[state], allowed)


@dataclass(frozen=True)
class Cusum:
    """Streaming twin of the windowed two-sided sum."""

    target: float
    slack: float
    limit: float
    fields = "up double, down double, n_up long, n_down long"
    out = "s_up double, s_down double, signal string, since long"

    def start(self):
        return (0.0, 0.0, 0, 0)

    def step(self, s, x, at=None):
        if not _finite(x):
            return s, None
        up, down, a, b = s
        up, down = max(0.0, up + x - self.target - self.slack), max(0.0, down + self.target - x - self.slack)
        a, b = (a + 1 if up > 0 else 0), (b + 1 if down > 0 else 0)
        signal = "up" if up > self.limit and up >= down else "down" if down > self.limit else "none"
        return (up, down, a, b), (up, down, signal, a if up >= down else b)


@dataclass(frozen=True)
class PageHinkley:
    delta: float
    limit: float
    fields = "n long, mean double, a double, low double, b double, high double"
    out = "up double, down double, signal string"

    def start(self):
        return (0, 0.0, 0.0, 0.0, 0.0, 0.0)

    def step(self, s, x, at=None):
        if not _finite(x):
            return s, None
        n, mean, a, low, b, high = s
        n += 1
        mean += (x - mean) / n
        a, b = a + x - mean - self.delta, b + x - mean + self.delta
        low, high = min(low, a), max(high, b)
        up, down = a - low, high - b
        signal = "up" if up > self.limit and up >= down else "down" if down > self.limit else "none"
        return (n, mean, a, low, b, high), (up, down, signal)
