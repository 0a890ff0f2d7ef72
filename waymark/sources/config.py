"""A repository's settings: strict TOML with defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class Settings:
    """Ceilings and thresholds of the checks. Names and defaults are fixed values."""

    root_tokens: int = 2000
    chain_bytes: int = 32768
    depth: int = 1
    exclude: tuple[str, ...] = ("node_modules", "_build", "deps", "target")
    disable: tuple[str, ...] = ()
    churn_threshold: int | None = None
    enforced_leash: int | None = None
    node_thresholds: dict[str, int] = field(default_factory=dict)


_PLACES = {
    "budget": {"root": "root_tokens", "chain": "chain_bytes"}, "exhaustiveness": {"depth": "depth", "exclude": "exclude"}, "check": {"disable": "disable"},
    "freshness": {"churn_threshold": "churn_threshold", "enforced_leash": "enforced_leash", "node": "node_thresholds"},
}


def _plain_id(raw: str) -> str:
    parts = [s for s in raw.replace("\\", "/").split("/") if s not in ("", ".")]
    return "/".join(parts) or "/"


def read_settings(text: str, classes: tuple[str, ...]) -> Settings:
    """The settings of a file; unknown keys, other types, unknown classes and node keys that mean one id are refused."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"settings: {e}") from e
    made: dict[str, Any] = {}
    kinds = {f.name: f.type for f in fields(Settings)}
    for table, keys in raw.items():
        if table not in _PLACES or not isinstance(keys, dict):
            raise ValueError(f"settings: unknown table {table!r}")
        for key, value in keys.items():
            name = _PLACES[table].get(key)
            if name is None:
                raise ValueError(f"settings: unknown key {table}.{key}")
            if name == "node_thresholds":
                nodes: dict[str, int] = {}
                for k, v in value.items():
                    if (same := _plain_id(k)) in nodes:
                        raise ValueError(f"settings: two keys of freshness.node mean {same!r}")
                    if not isinstance(v, int) or isinstance(v, bool) or v < 0:
                        raise ValueError(f"settings: freshness.node.{k} is no whole number")
                    nodes[same] = v
                made[name] = nodes
            elif kinds[name].startswith("tuple"):
                if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
                    raise ValueError(f"settings: {table}.{key} is no list of texts")
                made[name] = tuple(value)
            elif not isinstance(value, int) or isinstance(value, bool) or value < 0:
                raise ValueError(f"settings: {table}.{key} is no whole number")
            else:
                made[name] = value
    if other := sorted(set(made.get("disable", ())) - set(classes)):
        raise ValueError(f"settings: unknown class {other[0]!r}")
    return Settings(**made)
