"""Progress of running plans: metrics observed where rows pass, and callbacks that hear of them."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: (fraction, message): what a callback is told; fractions have four decimals.
Callback = Callable[[float, str], None]


class Progress:
    """Observes stages of a plan and tells a callback what passed each, without a pass of its own.

    passing() marks a point of the plan; every point is counted by the action that runs the plan anyway. told() gives the
    metrics after that action. A stage below a shuffle is counted again for tasks that run again after a lost executor, as
    accumulators are; points above the last shuffle are exact.
    """

    def __init__(self, callback: Callback | None = None):
        self.callback = callback
        self.stages: list[tuple[str, Observation]] = []

    def passing(self, df: DataFrame, name: str, **metrics: Column) -> DataFrame:
        """df, with the number of its rows and the given aggregates observed under the name."""
        seen = Observation(name)
        self.stages.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(k) for k, m in metrics.items()))

    def told(self) -> dict[str, dict]:
        """The metrics of each stage in the order of passing(), after an action; the callback hears of each in turn."""
        found = {}
        for i, (name, seen) in enumerate(self.stages):
            found[name] = seen.get
            if self.callback:
                self.callback(round((i + 1) / len(self.stages), 4), f"{name}: {found[name]['rows']} rows")
        return found


class StreamProgress(StreamingQueryListener):
    """Hears of the batches of streams that pass observed() under a name, sums their metrics and tells a callback.

    The fraction is that of `total` rows, or of nothing (0) where it is null or zero, 1 at most. Events come on the
    session's listener thread in the order of batches; finished() waits for the end of a query.
    """

    def __init__(self, name: str, total: int | None = None, callback: Callback | None = None):
        self.name, self.total, self.callback = name, total, callback
        self.sums: dict[str, float] = {}
        self.batches = 0
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def observed(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """df with its rows and the given sums or counts observed in each batch."""
        return df.observe(self.name, F.count(F.lit(1)).alias("rows"), *(m.alias(k) for k, m in metrics.items()))

    def _end(self, run: object) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event: object) -> None:
        self._end(event.runId)

    def onQueryProgress(self, event: object) -> None:
        self.add(event.progress.observedMetrics.get(self.name))

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        self._end(event.runId).set()

    def add(self, row: Row | None) -> None:
        """Counts one batch's metrics; a batch without them changes nothing."""
        if row is None:
            return
        for key, value in row.asDict().items():
            self.sums[key] = self.sums.get(key, 0) + (value or 0)
        self.batches += 1
        if self.callback:
            done = self.sums["rows"] / self.total if self.total else 0.0
            self.callback(round(min(1.0, done), 4), f"{self.name}: batch {self.batches}, {self.sums['rows']} rows")

    def finished(self, query: StreamingQuery, seconds: float = 120.0) -> dict[str, float]:
        """The sums after the query's end, when all its events have come; an error if they don't come in time."""
        query.awaitTermination()
        if not self._end(query.runId).wait(seconds):
            raise TimeoutError(f"no end of the stream was heard in {seconds} seconds")
        return dict(self.sums)
