"""Re-polling of open batches: keyed state with event-time timers.

Reports of batches arrive as files. A batch that is not done comes up again a
set time after its last report, again and again, until a terminal report or its
deadline ends it; an ended batch takes no further reports. All times are event
times, so the same reports give the same rows whatever micro-batches they come
in and wherever the query was stopped. Per open batch the state is one small
row and one timer; of an ended batch a mark stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from rankforge.streaming.registry import TERMINAL

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "kind string, at long, status string"


class _Poller(StatefulProcessor):
    """State (opened, seen, due, status) of one batch, times in milliseconds."""

    def __init__(self, every: int, limit: int, terminal):
        self.every, self.limit, self.terminal = every, limit, frozenset(terminal)

    def init(self, handle):
        self.handle = handle
        self.batch = handle.getValueState("batch", "opened long, due long, status string, ended boolean")

    def _until(self, state, now, rows):
        """Polls and the deadline that fall before ``now``."""
        opened, due, status, ended = state
        while not ended and min(due, opened + self.limit) < now:
            if opened + self.limit <= due:
                status, ended = "expired", True
                rows.append(("ended", opened + self.limit, status))
            else:
                rows.append(("poll", due, status))
                due += self.every
        return opened, due, status, ended

    def _keep(self, key, state):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.batch.update(state)
        opened, due, _, ended = state
        if not ended:
            self.handle.registerTimer(min(due, opened + self.limit))

    def _out(self, key, rows):
        if rows:
            kinds, times, statuses = zip(*rows)
            yield pd.DataFrame({"key": key[0], "kind": kinds, "at": times, "status": statuses})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        reports = sorted((at, tie, status) for pdf in rows for at, tie, status in zip(pdf["at_ms"], pdf["tie"], pdf["status"]))
        state, found = (tuple(self.batch.get()) if self.batch.exists() else None), []
        for at, _, status in reports:
            at = int(at)
            if state is not None:
                state = self._until(state, at, found)
                if state[3]:
                    break
            ended = status in self.terminal
            opened = at if state is None else state[0]
            state = (opened, at + self.every, status, ended)
            found.append(("ended" if ended else "report", at, status))
        self._keep(key, state)
        yield from self._out(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = []
        # the watermark has passed this time, so no report before it can come any more
        state = self._until(tuple(self.batch.get()), int(timerValues.getCurrentWatermarkInMs()), found)
        self._keep(key, state)
        yield from self._out(key, found)

    def close(self):
        pass


def polls(reports: DataFrame, key: str, at: str, status: str, tie: str, every: str, limit: str, delay: str = "0 seconds", terminal=TERMINAL) -> DataFrame:
    """``(key, kind, at, status)`` rows: each report, each time to ask again, each end.

    ``reports`` is a stream; ``every`` and ``limit`` are intervals, ``delay``
    how late a report may come. Two reports of the same time go by ``tie``.
    """
    millis = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    timed = reports.withWatermark(at, delay).select(
        F.col(key).alias("key"), F.col(at).alias("at"), F.unix_millis(at).alias("at_ms"), F.col(tie).alias("tie"), F.col(status).alias("status")
    )
    kind = timed.schema["key"].dataType.simpleString()
    processor = _Poller(millis(every), millis(limit), terminal)
    return timed.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, {EVENTS}", "Append", "EventTime")
