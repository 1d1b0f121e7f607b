"""A registry of named plugins by kind."""

from __future__ import annotations

from collections.abc import Callable

KINDS = ("fetcher", "parser", "middleware", "storage", "hook")


class Registry:
    def __init__(self) -> None:
        self._plugins: dict[str, tuple[str, object]] = {}
        self._hooks: dict[str, list[Callable]] = {}

    def register(self, name: str, kind: str, plugin: object) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        if name in self._plugins:
            raise ValueError(f"plugin {name!r} is registered already")
        self._plugins[name] = (kind, plugin)

    def get(self, name: str) -> object:
        return self._plugins[name][1]

    def by_kind(self, kind: str) -> list[str]:
        return sorted(n for n, (k, _) in self._plugins.items() if k == kind)

    def names(self) -> list[str]:
        return sorted(self._plugins)

    def unregister(self, name: str) -> None:
        kind, plugin = self._plugins.pop(name)
        if hasattr(plugin, "close"):
            plugin.close()

    def init(self, config: dict[str, object]) -> None:
        """Plugins with an init() get their own part of the configuration, in the order of names."""
        for name in self.names():
            if hasattr(p := self.get(name), "init"):
                p.init(config.get(name, {}))

    def on(self, event: str, fn: Callable) -> None:
        self._hooks.setdefault(event, []).append(fn)

    def fire(self, event: str, *args: object) -> None:
        for fn in self._hooks.get(event, ()):
            fn(*args)


def in_order(middlewares: list[tuple[int, object]], responses: bool = False) -> list[object]:
    """By priority, low first; for responses the other way round. Equal ones keep their order."""
    got = [m for _, m in sorted(middlewares, key=lambda m: m[0])]
    return got[::-1] if responses else got
