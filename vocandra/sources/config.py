"""Settings in layers: defaults, a file, dotted overrides; their checks and their fingerprint."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable, Mapping
from pathlib import Path

try:
    import yaml
except ImportError:  # settings may be JSON as well
    yaml = None

#: Counts up when rows that were written under the same settings are no longer valid.
SCHEMA_VERSION = 3


def merged_config(defaults: dict, *layers: Mapping, said: Callable[[str], None] | None = None) -> dict:
    """Nested settings, later layers over earlier ones. Keys that the defaults don't have are left out, and told to ``said``.

    A default that is an empty mapping takes any keys.
    """
    out = json.loads(json.dumps(defaults))
    for layer in layers:
        for key, value in layer.items():
            if key not in out and defaults:
                (said or warnings.warn)(f"unknown setting: {key}")
            elif isinstance(out.get(key), dict) and isinstance(value, Mapping):
                out[key] = merged_config(out[key], value, said=said)
            else:
                out[key] = list(value) if isinstance(value, tuple) else value
    return out


def dotted(overrides: Mapping[str, object]) -> dict:
    """``{"a.b": 1}`` as ``{"a": {"b": 1}}``."""
    out: dict = {}
    for name, value in overrides.items():
        *path, last = str(name).split(".")
        node = out
        for part in path:
            node = node.setdefault(part, {})
        node[last] = value
    return out


def load_config(defaults: dict, path: str | None = None, overrides: Mapping[str, object] | None = None, rules: Mapping[str, tuple] | None = None, said: Callable[[str], None] | None = None) -> dict:
    """Defaults, then the file at ``path`` (yaml, or JSON), then dotted overrides; checked by ``rules``. A missing file is told."""
    said = said or warnings.warn
    layers: list[Mapping] = []
    if path is not None:
        if not Path(path).exists():
            said(f"no settings at {path}")
        elif yaml is None and not path.endswith(".json"):
            said(f"no yaml library to read {path}")
        else:
            text = Path(path).read_text(encoding="utf-8")
            layers.append((json.loads(text) if path.endswith(".json") else yaml.safe_load(text)) or {})
    if overrides:
        layers.append(dotted(overrides))
    out = merged_config(defaults, *layers, said=said)
    validate(out, rules or {}, said)
    return out


def _at(settings: Mapping, name: str) -> object:
    for part in name.split("."):
        settings = settings[part]
    return settings


def validate(settings: Mapping, rules: Mapping[str, tuple], said: Callable[[str], None] | None = None) -> None:
    """rules: setting name to ("above", other name), ("one of", values) or ("sums to", total); the last is only told."""
    for name, (kind, against) in rules.items():
        value = _at(settings, name)
        if kind == "above" and value <= _at(settings, against):
            raise ValueError(f"{name} ({value}) must be above {against} ({_at(settings, against)})")
        if kind == "one of" and value not in against:
            raise ValueError(f"{name} must be one of {', '.join(map(str, against))}")
        if kind == "sums to" and abs(sum(value.values()) - against) > 0.001:
            (said or warnings.warn)(f"{name} sums to {sum(value.values()):.3f}; its parts are taken as shares")


def shares(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights that sum to 1."""
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else dict(weights)


def config_hash(settings: Mapping, without: tuple[str, ...] = (), version: int = SCHEMA_VERSION) -> str:
    """Of the settings that influence results: all but the dotted names in ``without``, and the schema's version."""
    kept = json.loads(json.dumps(settings, default=str))
    for name in without:
        *path, last = name.split(".")
        node = kept
        for part in path:
            node = node.get(part, {})
        node.pop(last, None)
    return hashlib.sha256(json.dumps({"settings": kept, "schema_version": version}, sort_keys=True).encode()).hexdigest()
