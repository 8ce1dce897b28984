"""Log lines with a time, a message and named values, and times of steps."""

from __future__ import annotations

import logging
import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

LOG = logging.getLogger("palimpsest")


def pairs(**values: object) -> str:
    """``a=1 b="two words"``: values with blanks or quotes are quoted."""
    shown = lambda v: s if (s := str(v)) and not set(s) & set(' "\n') else '"' + s.replace('"', '\\"').replace("\n", "\\n") + '"'
    return " ".join(f"{k}={shown(v)}" for k, v in values.items())


def info(message: str, **values: object) -> None:
    LOG.info("%s %s", message, pairs(**values))


def debug(message: str, **values: object) -> None:
    LOG.debug("%s %s", message, pairs(**values))


class Times:
    """Seconds and calls by step."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = defaultdict(float)
        self.calls: dict[str, int] = defaultdict(int)

    @contextmanager
    def step(self, name: str, **values: object) -> Iterator[None]:
        debug("begin", step=name, **values)
        start = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] += time.perf_counter() - start
            self.calls[name] += 1
            info("end", step=name, seconds=round(self.seconds[name], 3), **values)

    def report(self) -> list[tuple[str, int, float]]:
        """(step, calls, seconds), the slowest first."""
        return sorted(((n, self.calls[n], s) for n, s in self.seconds.items()), key=lambda x: -x[2])
