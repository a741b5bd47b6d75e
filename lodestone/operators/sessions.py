"""Searches that a newer one of the same session cancels."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession


class Cancelled(RuntimeError):
    """A newer search of the session has begun, or the session was cancelled or released."""


class Sessions:
    """Generations by session: a search that isn't its session's last is stopped. Session 0 is never cancelled."""

    def __init__(self, spark: SparkSession):
        self._context, self._lock, self._generations = spark.sparkContext, threading.Lock(), {}

    def _tag(self, session: int, generation: int) -> str:
        return f"search-{id(self)}-{session}-{generation}"

    def cancel(self, session: int) -> int:
        """Stop what runs in the session; the generation that follows."""
        with self._lock:
            generation = self._generations.get(session, 0)
            self._generations[session] = generation + 1
        if session:
            self._context.cancelJobsWithTag(self._tag(session, generation))
        return generation + 1

    def collect(self, session: int, make: Callable[[], DataFrame]) -> list[Row]:
        """The rows of a search; raises Cancelled if it was overtaken."""
        generation = self.cancel(session) if session else 0
        tag = self._tag(session, generation)
        self._context.addJobTag(tag)
        try:
            rows = make().collect()
        except Exception as e:
            if session and self._generations.get(session) != generation:
                raise Cancelled(f"session {session}") from e
            raise
        finally:
            self._context.removeJobTag(tag)
        if session and self._generations.get(session) != generation:
            raise Cancelled(f"session {session}")
        return rows
