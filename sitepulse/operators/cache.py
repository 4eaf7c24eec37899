"""Driver's side of serving: results kept for a while, and a bound on queries at a time."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from contextlib import contextmanager


class QueryCache:
    """Values by key for ``ttl`` seconds; when ``most`` are held, expired ones go, and if none does the new one isn't kept.  0 seconds: off."""

    def __init__(self, ttl: float = 60, most: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.most, self.clock = ttl, most, clock
        self.hits = self.misses = 0
        self._held: dict[str, tuple[float, object]] = {}
        self._lock = threading.Lock()

    def get(self, key: str):
        with self._lock:
            found = self._held.get(key)
            if found and self.clock() < found[0]:
                self.hits += 1
                return found[1]
            self.misses += 1
            return None

    def put(self, key: str, value) -> bool:
        with self._lock:
            if self.ttl <= 0:
                return False
            now = self.clock()
            if len(self._held) >= self.most and key not in self._held:
                self._held = {k: v for k, v in self._held.items() if now < v[0]}
                if len(self._held) >= self.most:
                    return False
            self._held[key] = now + self.ttl, value
            return True

    def forget(self, site_id: str | None = None) -> None:
        """Drop a site's results, as after an erasure, or all."""
        with self._lock:
            self._held = {} if site_id is None else {k: v for k, v in self._held.items() if f":{site_id}:" not in k}

    def through(self, key: str, make: Callable[[], object]):
        found = self.get(key)
        if found is None:
            found = make()
            self.put(key, found)
        return found


class TooBusy(RuntimeError):
    """All places for queries are taken."""


class QueryGate:
    """At most ``places`` heavy queries at a time; one more is refused, not queued."""

    def __init__(self, places: int = 10):
        self._places = threading.BoundedSemaphore(places)

    @contextmanager
    def enter(self):
        if not self._places.acquire(blocking=False):
            raise TooBusy("too many queries at a time")
        try:
            yield
        finally:
            self._places.release()
