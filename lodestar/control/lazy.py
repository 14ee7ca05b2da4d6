"""Deferred values: run at most once, started early if wanted."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any

from pyspark import inheritable_thread_target


class Lazy:
    """``Lazy(f)`` runs ``f`` on the first ``get`` or ``start``; every caller sees its one result or error."""

    def __init__(self, run: Callable[[], Any]):
        self._run, self._lock, self._job = run, threading.Lock(), None

    @classmethod
    def of(cls, value: Any) -> Lazy:
        return cls(lambda: value)

    def start(self) -> Lazy:
        """Begin in a thread that keeps the caller's Spark job group."""
        with self._lock:
            if self._job is None:
                self._job = Future()
                threading.Thread(target=inheritable_thread_target(self._work), daemon=True).start()
        return self

    def _work(self) -> None:
        try:
            self._job.set_result(self._run())
        except BaseException as e:  # noqa: BLE001
            self._job.set_exception(e)

    def get(self, timeout: float | None = None) -> Any:
        """Waits; running out of time stops the waiting, not the work."""
        if timeout is not None:
            return self.start()._job.result(timeout)
        with self._lock:
            mine = self._job is None
            if mine:
                self._job = Future()
        if mine:
            self._work()
        return self._job.result()

    def map(self, f: Callable[[Any], Any]) -> Lazy:
        return Lazy(lambda: f(self.get()))

    def then(self, f: Callable[[Any], Lazy]) -> Lazy:
        return Lazy(lambda: f(self.get()).get())

    @staticmethod
    def all(values: list[Lazy]) -> Lazy:
        def run():
            for v in values:
                v.start()
            return [v.get() for v in values]

        return Lazy(run)
