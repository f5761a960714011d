"""Budgets of time: work in slices that looks at the clock between them, and streams that end between batches."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Budget:
    """So many seconds from now on, unless it is cancelled before."""

    def __init__(self, seconds: float | None, clock: Callable[[], float] = time.monotonic):
        self._clock, self._cancelled = clock, threading.Event()
        self._end = None if seconds is None else clock() + seconds

    @property
    def left(self) -> float:
        return float("inf") if self._end is None else max(0.0, self._end - self._clock())

    @property
    def cancelled(self) -> bool:
        return self._cancelled.is_set()

    @property
    def expired(self) -> bool:
        return self.cancelled or self.left <= 0

    def cancel(self) -> None:
        self._cancelled.set()

    def over(self, items: Any, at_least: int = 0) -> Iterator[Any]:
        """The items while the budget lasts; the first ``at_least`` also when it is spent, but none once it is cancelled."""
        for done, item in enumerate(items):
            if self.cancelled or (done >= at_least and self.expired):
                return
            yield item


class Deadline(StreamingQueryListener):
    """Ends streams once their budget is spent, after the batch that is under way; what they have not read, the next run reads."""

    def __init__(self, budget: Budget):
        self.budget, self._queries = budget, {}

    def watch(self, query: StreamingQuery) -> StreamingQuery:
        self._queries[str(query.runId)] = query
        return query

    def _end(self, run_id: Any) -> None:
        if self.budget.expired and (query := self._queries.get(str(run_id))) and query.isActive:
            query.stop()

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        self._end(event.progress.runId)

    def onQueryIdle(self, event: Any) -> None:
        self._end(event.runId)

    def onQueryTerminated(self, event: Any) -> None:
        self._queries.pop(str(event.runId), None)
