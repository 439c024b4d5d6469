"""Logging on the driver, and elapsed seconds of stages."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def logger(name: str = "textloom", file: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """A logger to the console and, where one is named, to a file; asked for again, it gets no second handler of a kind."""
    log = logging.getLogger(name)
    log.setLevel(level)
    log.propagate = False
    wanted = [logging.StreamHandler()] if not any(type(h) is logging.StreamHandler for h in log.handlers) else []
    if file and not any(isinstance(h, logging.FileHandler) and h.baseFilename == str(Path(file).resolve()) for h in log.handlers):
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        wanted.append(logging.FileHandler(file, encoding="utf-8"))
    for h in wanted:
        h.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(h)
    return log


class Stages:
    """Elapsed seconds by stage, in order."""

    def __init__(self, log: logging.Logger | None = None):
        self.seconds: dict[str, float] = {}
        self.log = log

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began
            if self.log:
                self.log.info("%s: %.2f s", name, self.seconds[name])

    @property
    def total(self) -> float:
        return sum(self.seconds.values())
