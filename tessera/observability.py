"""Logging, and names for the jobs that a piece of work runs."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable
from typing import Any


def configure_logging(level: str | int = "INFO") -> None:
    log = logging.getLogger("tessera")
    log.setLevel(level)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)


def get_logger(name: str) -> logging.Logger:
    return logging.getLogger(f"tessera.{name}")


def traced(kind: str, name: str | None = None) -> Callable:
    """Logs how long calls take and, while they run, describes their Spark jobs."""

    def wrap(fn: Callable) -> Callable:
        label = f"{kind} {name or fn.__qualname__}"

        @functools.wraps(fn)
        def call(*args: Any, **kw: Any) -> Any:
            from pyspark.sql import SparkSession

            active, began = SparkSession.getActiveSession(), time.time()
            if active is not None:
                active.sparkContext.setJobDescription(label)
            try:
                return fn(*args, **kw)
            finally:
                if active is not None:
                    active.sparkContext.setJobDescription(None)
                get_logger(kind).debug("%s took %.3f s", label, time.time() - began)

        return call

    return wrap
