"""Events of runs, and where they go.

What a run tells becomes events of one shape, whatever the value is; a sink takes the events of a run when it ends. A table
sink appends them to a Spark table, where runs are compared with plain queries.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "run string, kind string, name string, number double, text string, step long, at double"
#: Rows of a frame that become events.
SHOWN = 1000


@dataclass(frozen=True)
class Event:
    run: str
    kind: str
    name: str
    number: float | None = None
    text: str | None = None
    step: int | None = None
    at: float = field(default_factory=time.time)


Sink = Callable[[list[Event]], None]


def table_sink(spark: SparkSession, path: str) -> Sink:
    """Adds to a Parquet table of ``SCHEMA``; a run's events are a partition of their own, so that runs which end together don't meet."""

    def put(events: list[Event]) -> None:
        rows = spark.createDataFrame([tuple(asdict(e).values()) for e in events], SCHEMA).coalesce(1)
        rows.write.parquet(f"{path}/added={uuid.uuid4().hex}")

    return put


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """What ``table_sink`` wrote."""
    return spark.read.option("basePath", path).schema(SCHEMA).parquet(f"{path}/added=*").select(*[f.split()[0] for f in SCHEMA.split(", ")])


def lines_sink(path: str) -> Sink:
    """Appends JSON lines to a file of the driver."""

    def put(events: list[Event]) -> None:
        with open(path, "a", encoding="utf-8") as out:
            out.writelines(json.dumps(asdict(e)) + "\n" for e in events)

    return put


def calling_sink(number: Callable[[str, float, int | None], None], text: Callable[[str, str], None]) -> Sink:
    """Hands each event to functions of a tracking service's client: ``(name, number, step)`` and ``(name, text)``."""

    def put(events: list[Event]) -> None:
        for e in events:
            if e.number is not None:
                number(e.name, e.number, e.step)
            elif e.text is not None:
                text(e.name, e.text)

    return put


class Log:
    """The events of one run so far."""

    def __init__(self, run: str):
        self.run, self.events = run, []

    def put(self, kind: str, values: dict[str, Any], step: int | None = None) -> None:
        """An event for each value: numbers as numbers, frames as their first rows, all else as text or JSON."""
        for name, value in values.items():
            number, text = None, None
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                number = float(value)
            elif isinstance(value, DataFrame):
                text = json.dumps([r.asDict(recursive=True) for r in value.limit(SHOWN).collect()], default=str)
            elif value is not None:
                text = value if isinstance(value, str) else json.dumps(value, default=str)
            self.events.append(Event(self.run, kind, name, number, text, step))


class Track:
    """Gives the events of runs to a sink; without one, they are dropped."""

    def __init__(self, sink: Sink | None = None):
        self.sink = sink

    @contextlib.contextmanager
    def run(self, name: str, config: dict[str, Any] | None = None) -> Iterator[Log]:
        log = Log(name)
        log.put("config", config or {})
        try:
            yield log
        finally:
            log.put("end", {"seconds": time.time() - log.events[0].at if log.events else 0.0})
            if self.sink:
                self.sink(log.events)
