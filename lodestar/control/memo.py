"""A cache whose concurrent callers of one key share one run."""

from __future__ import annotations

import hashlib
import struct
import threading
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any


def _canonical(v: Any) -> bytes:
    if v is None:
        tag, body = b"n", b""
    elif isinstance(v, bool):
        tag, body = b"b", b"\1" if v else b"\0"
    elif isinstance(v, int):
        tag, body = b"i", str(v).encode()
    elif isinstance(v, float):
        tag, body = b"f", struct.pack("<d", v + 0.0)
    elif isinstance(v, str):
        tag, body = b"s", v.encode()
    elif isinstance(v, (bytes, bytearray)):
        tag, body = b"y", bytes(v)
    elif isinstance(v, (list, tuple)):
        tag, body = b"l", b"".join(map(_canonical, v))
    elif isinstance(v, dict):
        tag, body = b"m", b"".join(k + x for k, x in sorted((_canonical(k), _canonical(x)) for k, x in v.items()))
    else:
        raise TypeError(f"{type(v).__name__} has no canonical form")
    return tag + struct.pack("<q", len(body)) + body


def cache_key(*parts: Any) -> str:
    """SHA-256 of a canonical form that tells types and boundaries apart."""
    return hashlib.sha256(_canonical(parts)).hexdigest()


class Memo:
    """At most ``size`` values, least recently used out first, each for ``ttl`` units of the caller's time.

    ``drop`` is called with a value that leaves, such as ``DataFrame.unpersist``.
    """

    def __init__(self, size: int = 1024, ttl: float | None = None, drop: Callable[[Any], Any] | None = None):
        self.size, self.ttl, self.drop = size, ttl, drop
        self._lock, self._held, self._running = threading.Lock(), OrderedDict(), {}
        self.hits = self.misses = self.shared = self.evicted = 0

    def do(self, key: str, run: Callable[[], Any], now: float = 0.0) -> Any:
        """The value of ``key``, run once however many ask at once; an error is given to all and not kept."""
        with self._lock:
            found, value = self._live(key, now)
            if found:
                self.hits += 1
                return value
            job = self._running.get(key)
            if job:
                self.shared += 1
            else:
                self.misses += 1
                own = self._running[key] = Future()
        if job:
            return job.result()
        try:
            value = run()
        except BaseException as e:
            with self._lock:
                self._running.pop(key, None)
            own.set_exception(e)
            raise
        self.set(key, value, now)
        with self._lock:
            self._running.pop(key, None)
        own.set_result(value)
        return value

    def _live(self, key: str, now: float) -> tuple[bool, Any]:
        if key not in self._held:
            return False, None
        value, since = self._held[key]
        if self.ttl is not None and now - since >= self.ttl:
            self._out(key)
            return False, None
        self._held.move_to_end(key)
        return True, value

    def _out(self, key: str) -> None:
        value, _ = self._held.pop(key)
        if self.drop:
            self.drop(value)

    def get(self, key: str, now: float = 0.0) -> Any:
        with self._lock:
            return self._live(key, now)[1]

    def set(self, key: str, value: Any, now: float = 0.0) -> None:
        with self._lock:
            self._held[key] = (value, now)
            self._held.move_to_end(key)
            while len(self._held) > self.size:
                self._out(next(iter(self._held)))
                self.evicted += 1

    def invalidate(self, key: str) -> None:
        with self._lock:
            if key in self._held:
                self._out(key)

    def purge(self) -> None:
        with self._lock:
            for key in list(self._held):
                self._out(key)

    def stats(self) -> dict[str, int]:
        return {"size": len(self._held), "hits": self.hits, "misses": self.misses, "shared": self.shared, "evicted": self.evicted}
