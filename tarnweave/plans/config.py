"""Job configuration: defaults, then a YAML file, then environment variables, then arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from ..functions.extract import Rule


@dataclass
class Config:
    seeds: list[str] = field(default_factory=list)
    max_depth: int = 3
    concurrency: int = 10
    delay_s: float = 1.0
    allowed_domains: list[str] = field(default_factory=list)
    disallowed_domains: list[str] = field(default_factory=list)
    respect_robots: bool = True
    max_body_bytes: int = 10 << 20
    max_retries: int = 3
    rules: list[Rule] = field(default_factory=list)
    storage: str = "json"
    output: str = "output"
    batch_size: int = 100

    def problems(self) -> list[str]:
        """What is wrong, empty if nothing."""
        out = []
        if not 1 <= self.concurrency <= 1000:
            out.append("concurrency must lie between 1 and 1000")
        if self.max_depth < 0:
            out.append("max_depth must not be negative")
        if self.delay_s < 0:
            out.append("delay_s must not be negative")
        if self.max_retries < 0:
            out.append("max_retries must not be negative")
        if self.storage not in ("json", "jsonl", "csv"):
            out.append("storage must be json, jsonl or csv")
        if self.batch_size < 1:
            out.append("batch_size must be positive")
        for r in self.rules:
            if not r.name or r.type not in ("css", "xpath", "regex"):
                out.append(f"rule {r.name!r}: needs a name and a type css, xpath or regex")
            elif not (r.pattern or r.selector):
                out.append(f"rule {r.name!r}: needs a selector or pattern")
        for u in self.seeds:
            if not u.startswith(("http://", "https://")) or len(u.partition("://")[2]) == 0:
                out.append(f"seed {u!r} is no web address")
        return out


def _typed(kind: object, raw: str) -> object:
    kind = str(kind)
    if kind == "int":
        return int(raw)
    if kind == "float":
        return float(raw)
    if kind == "bool":
        return raw.lower() in ("1", "true", "yes")
    return [x for x in raw.split(",") if x] if kind.startswith("list") else raw


def load(path: str | None = None, prefix: str = "TARNWEAVE_", **arguments: object) -> Config:
    values: dict[str, object] = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            values |= yaml.safe_load(f) or {}
    for f_ in fields(Config):
        if (raw := os.environ.get(prefix + f_.name.upper())) is not None:
            values[f_.name] = _typed(f_.type, raw)
    values |= {k: v for k, v in arguments.items() if v is not None}
    values["rules"] = [r if isinstance(r, Rule) else Rule(**r) for r in values.get("rules") or []]
    known = {f_.name for f_ in fields(Config)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    config = Config(**values)
    if bad := config.problems():
        raise ValueError("; ".join(bad))
    return config
