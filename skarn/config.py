"""Settings: a file, and dotted overrides of single values."""

from __future__ import annotations

import json
from pathlib import Path


def load_config(path: str, overrides: tuple[str, ...] | list[str] = ()) -> dict:
    """The mapping in a JSON or YAML file, with overrides such as train.epochs=3 put in.

    A value is read as JSON where it is JSON, and as text otherwise; tables on the way are made.
    """
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        config = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"{path} is read with the yaml package; a .json file needs none") from e
        config = yaml.safe_load(text) or {}
    if not isinstance(config, dict):
        raise ValueError(f"{path} holds no mapping")
    for item in overrides:
        name, found, value = item.partition("=")
        if not found or not all(name.split(".")):
            raise ValueError(f"{item!r} isn't name=value")
        at, *rest = config, *name.split(".")
        for part in rest[:-1]:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                raise ValueError(f"{part} of {name} holds a value, no table")
        try:
            at[rest[-1]] = json.loads(value)
        except ValueError:
            at[rest[-1]] = value
    return config
