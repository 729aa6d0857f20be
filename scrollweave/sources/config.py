"""Settings of a run: one table of names, from dicts or YAML, with overrides."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import Any

#: The settings that something here reads, by section, with their defaults, as files of settings name them.
DEFAULTS: dict[str, dict[str, Any]] = {
    "frame_extraction": {"fps": 2.0, "skip_similar_threshold": 0.95, "max_frames": None},
    "ocr": {"engine": "easyocr", "languages": ("en",), "confidence_threshold": 0.5, "gpu": True},
    "deduplication": {"similarity_threshold": 0.85, "min_new_chars": 10, "window_size": 3},
    "transcript_parsing": {"merge_consecutive": True},
    "output": {"include_metadata": True, "include_statistics": True, "include_raw_text": True},
}


class Settings(Mapping[str, Any]):
    """``settings["ocr.engine"]``: values by section and name; those that aren't given are the defaults.

    Sections or names that are no setting are a KeyError.
    """

    def __init__(self, given: Mapping[str, Mapping[str, Any] | None] | None = None):
        self._values = {f"{section}.{name}": value for section, names in DEFAULTS.items() for name, value in names.items()}
        for section, names in (given or {}).items():
            if section not in DEFAULTS:
                raise KeyError(f"no section of settings: {section}")
            for name, value in (names or {}).items():
                self._put(f"{section}.{name}", value)

    def _put(self, key: str, value: Any) -> None:
        if key not in self._values:
            raise KeyError(f"no setting: {key}")
        self._values[key] = tuple(value) if isinstance(value, list) else value

    def __getitem__(self, key: str) -> Any:
        return self._values[key]

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def nested(self) -> dict[str, dict[str, Any]]:
        """By section, as a file has them."""
        return {section: {name: self[f"{section}.{name}"] for name in names} for section, names in DEFAULTS.items()}

    def overridden(self, changes: Mapping[str, Mapping[str, Any] | None]) -> Settings:
        """With ``changes``, of which None changes nothing."""
        out = Settings(self.nested())
        for section, names in changes.items():
            for name, value in (names or {}).items():
                if value is not None:
                    out._put(f"{section}.{name}", value)
        return out


def from_yaml(path: str | Path) -> Settings:
    import yaml

    return Settings(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def find(path: str | Path | None = None, places: tuple[str | Path, ...] = ("config/default.yaml", "~/.scrollweave/config.yaml", "/etc/scrollweave/config.yaml")) -> Settings:
    """From ``path``, if there is such a file, or the first of ``places`` that there is; else the defaults."""
    for place in (path,) if path else places:
        if (file := Path(place).expanduser()).exists():
            return from_yaml(file)
    return Settings()
