"""Wall-clock times of stages, for people: never part of any output."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

log = logging.getLogger("millrace")


class StageTimer:
    """Collects (stage, milliseconds); a sink that fails does not fail the run."""

    def __init__(self, enabled: bool = True, sink: Callable[[list[dict]], None] | None = None) -> None:
        self.enabled, self.sink = enabled, sink
        self.rows: list[dict] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            if self.enabled:
                self.rows.append({"stage": name, "ms": round(1000 * (time.perf_counter() - began), 1)})

    def report(self) -> None:
        for row in self.rows:
            log.info("%(stage)s: %(ms).1f ms", row)
        if self.sink and self.rows:
            try:
                self.sink(list(self.rows))
            except Exception:  # noqa: BLE001 - a diagnostic must not end the run
                log.debug("the timing sink raised", exc_info=True)


def configure_logging(verbose: int = 0, quiet: bool = False) -> None:
    """Messages to stderr: warnings, with one -v the progress, with two all; with quiet errors only."""
    level = logging.ERROR if quiet else [logging.WARNING, logging.INFO, logging.DEBUG][min(verbose, 2)]
    handler = logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(message)s"))
    log.handlers[:] = [handler]
    log.setLevel(level)
    log.propagate = False
