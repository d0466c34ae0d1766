"""Handles for callers outside Spark: plain Python values instead of frames, blocking and asynchronous, for one space or several.

Unlike the store's own reads they refuse namespace 0. Results are as large as what is asked for: lists without a limit come
whole to the caller, so large namespaces are for the page calls."""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator

from .errors import Malformed
from .runtime import Ledger
from .sources.store import CancelToken, Container, MultiSpace, Space
from .streaming import pages


def _checked(namespace: int) -> int:
    if not 1 <= namespace <= 255:
        raise Malformed("namespace must be 1 to 255")
    return namespace


class SpaceHandle:
    """One space, blocking."""

    def __init__(self, space: Space):
        self.space = space

    def get(self, namespace: int, key: bytes) -> bytes | None:
        return self.space.get(_checked(namespace), key)

    def list_keys(self, namespace: int) -> list[bytes]:
        return [bytes(r.key) for r in self.space.list_keys(_checked(namespace)).collect()]

    def list_keys_after(self, namespace: int, after: bytes | None, limit: int) -> list[bytes]:
        return [bytes(r.key) for r in self.space.list_keys_after(_checked(namespace), after, limit).collect()]

    def list_after(self, namespace: int, after: bytes | None, limit: int) -> list[tuple[bytes, bytes]]:
        return [(bytes(r.key), bytes(r.value)) for r in self.space.list_after(_checked(namespace), after, limit).collect()]

    def count(self, namespace: int) -> int:
        return self.space.count(_checked(namespace))

    def read_log(self, namespace: int, log_id: int) -> bytes | None:
        return self.space.read_log(_checked(namespace), log_id)

    def log_after(self, namespace: int, after: int | None, limit: int) -> list[tuple[int, bytes]]:
        return [(r.log_id, bytes(r.payload)) for r in self.space.iter_log_after(_checked(namespace), after, limit).collect()]

    def log_before(self, namespace: int, before: int | None, limit: int) -> list[tuple[int, bytes]]:
        return [(r.log_id, bytes(r.payload)) for r in self.space.iter_log_before(_checked(namespace), before, limit).collect()]

    def log_range(self, namespace: int, start: int, end: int, limit: int) -> list[tuple[int, bytes]]:
        return [(r.log_id, bytes(r.payload)) for r in self.space.iter_log_range(_checked(namespace), start, end, limit).collect()]

    def commit(self, ops: list[tuple]) -> int:
        for _, namespace, *_ in ops:
            _checked(namespace)
        return self.space.commit(ops)

    def erase_namespace(self, namespace: int) -> int:
        return self.space.erase_namespace(_checked(namespace))

    def stats(self) -> dict:
        """Statistics with the sticky hardening failure."""
        return self.space.stats() | {"hardening_error": self.space.last_hardening_error()}

    def __getattr__(self, name: str):
        if name in ("commit_seq", "commit_history", "list_namespaces", "list_namespaces_with_kind", "vacuum", "verify", "triage", "space_keys", "last_hardening_error", "acknowledge_hardening_error", "last_publish_error"):
            return getattr(self.space, name)
        raise AttributeError(name)


class AsyncSpaceHandle:
    """One space for event loops: every call of a SpaceHandle as a coroutine, one at a time. What became of a call that
    was cancelled while it ran can be asked of the ledger."""

    def __init__(self, handle: SpaceHandle, ledger: Ledger | None = None):
        self.handle, self.ledger = handle, ledger or Ledger()

    async def call(self, name: str, *args, cancel: CancelToken | None = None):
        number, future = self.ledger.run(getattr(self.handle, name), *args, cancel=cancel)
        try:
            return await asyncio.shield(asyncio.wrap_future(future))
        except asyncio.CancelledError:
            self.ledger.abandon(number, future)
            raise

    def __getattr__(self, name: str):
        getattr(self.handle, name)  # unknown names fail here
        return lambda *args, **more: self.call(name, *args, **more)

    async def _pages(self, source) -> AsyncIterator[list]:
        end = object()
        while (page := await asyncio.wrap_future(self.ledger.run(next, source, end)[1])) is not end:
            yield page

    def pages_after(self, namespace: int, after: int | None, size: int) -> AsyncIterator[list]:
        return self._pages(pages.pages_after(self.handle.space.log(_checked(namespace)), namespace, after, size))

    def pages_before(self, namespace: int, before: int | None, size: int) -> AsyncIterator[list]:
        return self._pages(pages.pages_before(self.handle.space.log(_checked(namespace)), namespace, before, size))

    def range_pages(self, namespace: int, start: int, end: int, size: int) -> AsyncIterator[list]:
        return self._pages(pages.range_pages(self.handle.space.log(_checked(namespace)), namespace, start, end, size))


class MultiSpaceHandle:
    """Several spaces of a container, each call with the number of its space first."""

    def __init__(self, container: Container):
        self.host = MultiSpace(container)

    def open_space(self, password: str) -> int:
        return self.host.open_space(password)

    def create_space(self, password: str) -> int:
        return self.host.create_space(password)

    def __len__(self) -> int:
        return len(self.host)

    def __getattr__(self, name: str):
        def call(number: int, *args):
            return self.host.with_space(number, lambda space: getattr(SpaceHandle(space), name)(*args))

        return call
