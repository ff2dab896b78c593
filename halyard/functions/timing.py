"""Log how long a block takes."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger("halyard")


@contextmanager
def timer(message: str, log_start: bool = False, level: int = logging.INFO) -> Iterator[None]:
    if log_start:
        log.log(level, "%s ...", message)
    began = time.perf_counter()
    try:
        yield
    finally:
        log.log(level, "%s: %.3f s", message, time.perf_counter() - began)
