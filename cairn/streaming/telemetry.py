"""Counts of what passes through a job, told to a sink when the job ends.

Metrics ride on the plan (``observe``): they cost no pass of their own, and a task that runs again is counted once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = ("chunk", "file", "pack")


class Sink(Protocol):
    """What wants to know."""

    def told(self, event: str, counts: dict[str, int]) -> None: ...


class Totals:
    """A sink that adds up."""

    def __init__(self):
        self.counts: dict[str, dict[str, int]] = {}

    def told(self, event: str, counts: dict[str, int]) -> None:
        own = self.counts.setdefault(event, {})
        for name, n in counts.items():
            own[name] = own.get(name, 0) + (n or 0)


class Watch:
    """Frames that are watched, and the sink that hears of them."""

    def __init__(self, sink: Sink | None = None):
        self.sink, self._open = sink, []

    def on(self, event: str, rows: DataFrame, size: str | None = None) -> DataFrame:
        """The same rows; their number (and the sum of ``size``) is told once an action has read them all.  Without a sink, nothing is added."""
        if event not in EVENTS:
            raise ValueError(f"{event} is none of {EVENTS}")
        if self.sink is None:
            return rows
        seen = Observation(f"{event}-{len(self._open)}")
        self._open.append((event, seen))
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *([F.sum(size).alias("bytes")] if size else []))

    def emit(self) -> None:
        """Tell the sink; after the actions.  Waits for a frame that no action has read."""
        for event, seen in self._open:
            self.sink.told(event, seen.get)
        self._open = []


def progress(query: StreamingQuery, heard: Callable[[int, int], None]) -> int:
    """Tell (rows so far, rows in the last batch) of each batch that a query has done; how many batches there were."""
    done = 0
    reports = query.recentProgress
    for p in reports:
        done += p["numInputRows"]
        heard(done, p["numInputRows"])
    return len(reports)
