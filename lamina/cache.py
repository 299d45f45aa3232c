"""A driver-side cache of small results (schemas, listings, statistics) with a time to live; data belongs in Spark's own cache."""

from __future__ import annotations

import time
from collections.abc import Callable, Hashable
from typing import Any


class Cache:
    """Values live ``ttl`` seconds unless they bring their own time; beyond ``capacity`` the one that expires first goes."""

    def __init__(self, ttl: float = 300.0, capacity: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.capacity, self.clock = ttl, capacity, clock
        self._found: dict[Hashable, tuple[float, Any]] = {}
        self.hits = self.misses = 0

    def get(self, key: Hashable, default: Any = None) -> Any:
        until, value = self._found.get(key, (float("-inf"), None))
        if until <= self.clock():
            self._found.pop(key, None)
            self.misses += 1
            return default
        self.hits += 1
        return value

    def set(self, key: Hashable, value: Any, ttl: float | None = None) -> None:
        if key not in self._found and len(self._found) >= self.capacity:
            del self._found[min(self._found, key=lambda k: self._found[k][0])]
        self._found[key] = (self.clock() + (self.ttl if ttl is None else ttl), value)

    def get_or_set(self, key: Hashable, make: Callable[[], Any], ttl: float | None = None) -> Any:
        """The value, made only if there is none; None is a value too."""
        missing = object()
        found = self.get(key, missing)
        if found is missing:
            found = make()
            self.set(key, found, ttl)
        return found

    def drop(self, key: Hashable) -> bool:
        return self._found.pop(key, None) is not None

    def clear(self) -> None:
        self._found.clear()

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"size": len(self._found), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}
