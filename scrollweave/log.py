"""Logging of the package: to the console, and to a file if one is named."""

from __future__ import annotations

import logging
from pathlib import Path

NAME = "scrollweave"
FORM = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def set_up(level: str = "INFO", file: str | Path | None = None) -> logging.Logger:
    """The package's logger; handlers of an earlier call go. A name that is no level counts as INFO."""
    log = logging.getLogger(NAME)
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    log.setLevel(getattr(logging, level.upper(), logging.INFO))
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file is not None:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(file, encoding="utf-8"))
    for handler in handlers:
        handler.setFormatter(logging.Formatter(FORM))
        log.addHandler(handler)
    return log
