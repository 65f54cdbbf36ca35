"""Strict run configuration from YAML, checked before anything is read."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

try:
    import yaml
except ImportError:  # configuration files need it, nothing else does
    yaml = None


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class CountConfig:
    groups: dict[str, list[str]]
    unit: str = "lemma"
    upos_targets: list[str] = field(default_factory=lambda: ["NOUN"])
    min_length: int = 1
    drop_roman_numerals: bool = False
    roman_exceptions: list[str] = field(default_factory=list)
    output: str = "output"


def load(text: str) -> dict[str, Any]:
    """A mapping; repeated and merge keys, keys that aren't text and numbers that aren't finite are refused."""
    if yaml is None:
        raise ConfigError("no YAML reader is installed")

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        out = {}
        for key_node, value_node in node.value:
            key = loader.construct_object(key_node, deep=True)
            if key_node.tag == "tag:yaml.org,2002:merge" or not isinstance(key, str) or key in out:
                raise ConfigError(f"bad or repeated key: {key!r}")
            value = loader.construct_object(value_node, deep=True)
            if isinstance(value, float) and (value != value or abs(value) == float("inf")):
                raise ConfigError(f"{key} isn't finite")
            out[key] = value
        return out

    Strict.add_constructor("tag:yaml.org,2002:map", mapping)
    found = yaml.load(text, Strict)
    if not isinstance(found, dict):
        raise ConfigError("the root must be a mapping")
    return found


def count_config(values: dict[str, Any]) -> CountConfig:
    known = {f.name for f in fields(CountConfig)}
    if extra := set(values) - known:
        raise ConfigError(f"unknown keys: {sorted(extra)}")
    if not values.get("groups"):
        raise ConfigError("no groups")
    config = CountConfig(**values)
    if config.unit not in ("lemma", "surface") or config.min_length < 1:
        raise ConfigError("unit or min_length is out of range")
    return config
