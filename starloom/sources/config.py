"""Rule sets and source lists from YAML."""

from __future__ import annotations

from pathlib import Path
from typing import Any


class ConfigError(Exception):
    """A configuration file is absent or not what it should be."""


def load_yaml(path: str | Path, key: str | None = None) -> dict[str, Any]:
    import yaml

    if not Path(path).exists():
        raise ConfigError(f"no file {path}")
    try:
        value = yaml.safe_load(Path(path).read_text()) or {}
    except yaml.YAMLError as e:
        raise ConfigError(f"{path}: {e}") from e
    if key is None:
        return value
    if key not in value:
        raise ConfigError(f"{path} has no {key!r}")
    return value[key]


def load_sources(path: str | Path) -> dict[str, Any]:
    return load_yaml(path, "sources")
