"""Driver-side extension points: hooks around stages, and registries of parsers, models and renderers by name."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Any

log = logging.getLogger(__name__)


class Hooks:
    """Functions by event. One that fails is logged and skipped; those behind it still run."""

    def __init__(self) -> None:
        self._by_event: dict[str, list[Callable]] = {}

    def register(self, event: str, function: Callable) -> None:
        self._by_event.setdefault(event, []).append(function)

    def unregister(self, event: str, function: Callable) -> None:
        """Drops the first registration of the function; unknown ones are ignored."""
        own = self._by_event.get(event, [])
        if function in own:
            own.remove(function)

    def of(self, event: str) -> list[Callable]:
        return list(self._by_event.get(event, []))

    def trigger(self, event: str, *args: Any, **kwargs: Any) -> list[Any]:
        """Results of the functions that didn't fail, in order of registration."""
        results = []
        for function in self.of(event):
            try:
                results.append(function(*args, **kwargs))
            except Exception:
                log.exception("hook of %s failed", event)
        return results


class Registry:
    """Functions or classes by (kind, name): a later registration replaces an earlier one."""

    def __init__(self) -> None:
        self._found: dict[tuple[str, str], Any] = {}

    def add(self, kind: str, name: str, what: Any) -> None:
        self._found[kind, name.lower()] = what

    def get(self, kind: str, name: str) -> Any:
        found = self._found.get((kind, name.lower()))
        if found is None:
            raise KeyError(f"no {kind} called {name}; there are: {', '.join(self.names(kind)) or 'none'}")
        return found

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._found if k == kind)


class PluginManager:
    """Plugins by name with their life: registered, started with a context, stopped in the opposite order.

    A plugin is an object with ``name`` and, if it wants, ``start(context)`` and ``stop()``. One whose start fails is logged and stays stopped.
    """

    def __init__(self, context: dict[str, Any] | None = None):
        self.context, self.hooks, self.registry = context or {}, Hooks(), Registry()
        self._plugins: dict[str, Any] = {}
        self._running: list[str] = []

    def add(self, plugin: Any) -> None:
        if plugin.name in self._plugins:
            raise ValueError(f"a plugin called {plugin.name} is there already")
        self._plugins[plugin.name] = plugin

    def remove(self, name: str) -> None:
        self.stop(name)
        self._plugins.pop(name, None)

    def start(self, *names: str) -> list[str]:
        """Starts the named plugins, or all, in order of their registration; the names of those that now run."""
        for name in names or tuple(self._plugins):
            if name in self._running:
                continue
            try:
                getattr(self._plugins[name], "start", lambda context: None)({**self.context, "hooks": self.hooks, "registry": self.registry})
                self._running.append(name)
            except Exception:
                log.exception("plugin %s did not start", name)
        return list(self._running)

    def stop(self, *names: str) -> None:
        for name in [n for n in reversed(self._running) if not names or n in names]:
            self._running.remove(name)
            try:
                getattr(self._plugins[name], "stop", lambda: None)()
            except Exception:
                log.exception("plugin %s did not stop", name)

    def running(self) -> list[str]:
        return list(self._running)


class Dispatcher:
    """Engines in order of registration; the first whose ``can_handle`` says yes to a kind is the one. As SQL: a CASE over kinds known beforehand."""

    def __init__(self) -> None:
        self._engines: list[tuple[Callable[[str], bool], Callable]] = []

    def add(self, can_handle: Callable[[str], bool], engine: Callable) -> None:
        self._engines.append((can_handle, engine))

    def of(self, kind: str) -> Callable | None:
        return next((engine for can_handle, engine in self._engines if can_handle(kind)), None)

    def column(self, kind: str, *kinds: str):
        """The engines' expressions over rows: each engine is called once a kind and gives a column; kinds without an engine are null."""
        from pyspark.sql import functions as F

        out = F.lit(None)
        for k in reversed(kinds):
            engine = self.of(k)
            if engine is not None:
                out = F.when(F.col(kind) == k, engine(k)).otherwise(out)
        return out


def theme_source(source: dict[str, str] | Callable[[], dict[str, str]]):
    """A theme's or the global styles' properties as a map column; a callable is asked once, when the plan is made."""
    from pyspark.sql import functions as F

    found = source() if callable(source) else source
    pairs = [F.lit(x) for pair in sorted(found.items()) for x in pair]
    return F.create_map(*pairs) if pairs else F.expr("cast(map() AS map<string,string>)")
