"""Settings in layers: defaults, files, then the environment; typed by the defaults, with the origin of every value."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any


class SettingError(ValueError):
    """An unknown name, a source that cannot be read, or a value of another type."""


@dataclass(frozen=True)
class Setting:
    value: Any
    origin: str


def _typed(value: Any, default: Any, where: str, from_text: bool = False) -> Any:
    """``value`` as of the default's type; a text stands for a number where a number is due, or any type from the environment."""
    kind = type(default)
    if isinstance(value, str) and kind is not str:
        if kind is bool:
            if from_text and value.lower() in ("true", "false"):
                return value.lower() == "true"
        elif kind in (int, float):
            try:
                return kind(value)
            except ValueError:
                pass
        raise SettingError(f"{where}: {value!r} is no {kind.__name__}")
    if kind is float and type(value) is int:
        return float(value)
    if type(value) is not kind:  # a bool is no int
        raise SettingError(f"{where} must be {kind.__name__}, got {type(value).__name__}")
    return value


class Settings:
    """``settings["section", "key"]`` is the value; ``origin`` tells where it came from."""

    def __init__(self, values: dict[tuple[str, str], Setting]):
        self._values = values

    def __getitem__(self, name: tuple[str, str]) -> Any:
        return self._values[name].value

    def origin(self, section: str, key: str) -> str:
        return self._values[section, key].origin

    def spark_conf(self, section: str = "spark") -> dict[str, str]:
        """One section as settings of a session, under its own prefix."""
        return {f"{section}.{key}": str(s.value).lower() if isinstance(s.value, bool) else str(s.value) for (part, key), s in self._values.items() if part == section}


def load(defaults: Mapping[str, Mapping[str, Any]], files: Iterable[str | Path] = (), env: Mapping[str, str] | None = None, prefix: str = "SEXTANT_", reserved: Iterable[str] = ()) -> Settings:
    """Later layers win: ``files`` (TOML) in order, then ``env`` names ``<prefix><SECTION>_<KEY>``.

    A name that the defaults do not have is refused in either, so that a slip of the pen is
    no silent default; ``reserved`` environment names are passed over.
    """
    values = {(section, key): Setting(value, "defaults") for section, entries in defaults.items() for key, value in entries.items()}
    for path in files:
        try:
            parsed = tomllib.loads(Path(path).read_bytes().decode())
        except (OSError, ValueError) as e:  # a path with a null byte and text that is no TOML among them
            raise SettingError(f"{path}: {e}") from e
        for section, entries in parsed.items():
            if section not in defaults or not isinstance(entries, dict):
                raise SettingError(f"{path}: unknown section {section}")
            for key, value in entries.items():
                if (section, key) not in values:
                    raise SettingError(f"{path}: unknown setting {section}.{key}")
                values[section, key] = Setting(_typed(value, defaults[section][key], f"{path}: {section}.{key}"), str(path))
    names = {f"{prefix}{section}_{key}".upper(): (section, key) for section, key in values}
    if len(names) < len(values):
        raise SettingError("two settings share an environment name")
    for name, text in (env or {}).items():
        if name.startswith(prefix) and name not in set(reserved):
            if name not in names:
                raise SettingError(f"unknown variable {name}; known: {', '.join(sorted(names))}")
            section, key = names[name]
            values[section, key] = Setting(_typed(text, defaults[section][key], name, True), name)
    return Settings(values)
