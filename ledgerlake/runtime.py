"""Calls in the background, one at a time for each handle, with a ledger of those whose callers left."""

from __future__ import annotations

import itertools
import threading
from concurrent.futures import Future, ThreadPoolExecutor

from .errors import Cancelled
from .sources.store import CancelToken

SETTLED = ("never_started", "succeeded", "failed", "lost")


class Ledger:
    """Runs functions in a thread. abandon() gives up waiting; what became of such a call can be asked for later."""

    def __init__(self, capacity: int = 128):
        self.capacity, self.forgotten = capacity, 0
        self._pool, self._lock, self._ids = ThreadPoolExecutor(1), threading.Lock(), itertools.count(1)
        self._state: dict[int, str] = {}
        self._abandoned: dict[int, None] = {}

    def run(self, f, *args, cancel: CancelToken | None = None) -> tuple[int, Future]:
        number = next(self._ids)
        self._state[number] = "queued"

        def call():
            if cancel and cancel.is_cancelled():
                self._state[number] = "never_started"
                raise Cancelled
            self._state[number] = "running"
            try:
                out = f(*args)
            except BaseException:
                self._state[number] = "failed"
                raise
            self._state[number] = "succeeded"
            return out

        return number, self._pool.submit(call)

    def abandon(self, number: int, future: Future) -> None:
        if future.cancel():
            self._state[number] = "never_started"
        with self._lock:
            self._abandoned[number] = None
            while len(self._abandoned) > self.capacity:
                oldest = next((n for n in self._abandoned if self._state[n] in SETTLED), next(iter(self._abandoned)))
                del self._abandoned[oldest]
                self.forgotten += 1

    def abandoned_operations(self) -> list[tuple[int, str]]:
        with self._lock:
            return [(n, self._state[n]) for n in self._abandoned]

    def clear_settled_operations(self) -> int:
        with self._lock:
            done = [n for n in self._abandoned if self._state[n] in SETTLED]
            for n in done:
                del self._abandoned[n]
            return len(done)


def may_have_mutated(state: str) -> bool:
    return state != "never_started"
