"""Streams with a state of their own: a running gauge and the life of tasks.

Rows wait until the watermark has passed them, so they are taken in the order
of their time whatever order they arrive in. Each key has one packed state and
one timer for the first row that waits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from embedlake.streaming.jobs import LATENESS

FINISHED = ("D", "F")
RETENTION_MS = 24 * 3600 * 1000


def _timer(handle: StatefulProcessorHandle, micros: int) -> None:
    """Wakes the key as soon as the watermark has passed an instant."""
    handle.registerTimer(int(-(-micros // 1000)))


class _Gauge(StatefulProcessor):
    """Open requests of one key: a total, and the changes the watermark has not passed."""

    def __init__(self, by: Sequence[str]):
        self.by = list(by)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "total bigint, instants array<bigint>, changes array<bigint>")

    def _load(self) -> tuple[int, np.ndarray, np.ndarray]:
        held = self.state.get() if self.state.exists() else (0, [], [])
        return int(held[0]), np.array(held[1], "i8"), np.array(held[2], "i8")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, instants, changes = self._load()
        first = instants[0] if len(instants) else None
        for frame in rows:
            # Sums per instant, so the state grows with instants and not with rows.
            instants, place = np.unique(np.concatenate([instants, frame["instant_us"].to_numpy("i8")]), return_inverse=True)
            changes = np.bincount(place, np.concatenate([changes, frame["change"].to_numpy("i8")]), len(instants)).astype("i8")
        self.state.update((total, instants.tolist(), changes.tolist()))
        if len(instants) and instants[0] != first:
            _timer(self.handle, int(instants[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, instants, changes = self._load()
        due = int(np.searchsorted(instants, timerValues.getCurrentWatermarkInMs() * 1000, "right"))
        if due:
            totals = total + np.cumsum(changes[:due])
            total = int(totals[-1])
            out = {name: [value] * due for name, value in zip(self.by, key)}
            yield pd.DataFrame(out | {"instant": pd.to_datetime(instants[:due], unit="us"), "in_flight": totals})
        if due == len(instants) and total == 0:
            self.state.clear()
            return
        self.state.update((total, instants[due:].tolist(), changes[due:].tolist()))
        if due < len(instants):
            _timer(self.handle, int(instants[due]))

    def close(self) -> None:
        pass


def running_gauge(
    requests: DataFrame,
    by: Sequence[str] = ("method", "path"),
    request_id: str = "event_id",
    lateness: str = LATENESS,
) -> DataFrame:
    """Requests in flight right after every instant at which their number changes.

    `requests` is a stream of `ts, duration_s`, an id and the columns `by`. A
    request that comes again within the lateness counts once, rows later than
    the lateness and rows without a time are dropped. An instant is told once
    the watermark has passed it, in order; write with output mode append. State
    per key is its open changes, and a key that is idle has none.
    """
    told = requests.where(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    told = told.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([request_id])
    begin = F.unix_micros("ts")
    end = begin + F.round(F.col("duration_s").cast("decimal(18,6)") * 1_000_000).cast("long")
    steps = F.inline(
        F.array(
            F.struct(begin.alias("instant_us"), F.lit(1).cast("long").alias("change")),
            F.struct(end.alias("instant_us"), F.lit(-1).cast("long").alias("change")),
        )
    )
    changes = told.select(*by, "ts", "duration_s").select(*by, "ts", steps)
    schema = T.StructType([requests.schema[c] for c in by]).add("instant", "timestamp").add("in_flight", "long")
    return changes.groupBy(*by).transformWithStateInPandas(
        _Gauge(by), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


_TASK = "task_status string, end_us bigint, error_msg string, progress double, refused bigint"
# The first time that waits, and the events as JSON: what a row costs is its columns.
_WAITING = "first bigint, events array<string>"


def packed_event() -> Column:
    """JSON of an event of the log, its time first."""
    event = F.struct(
        F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), "task_status", "error_msg",
        F.nanvl(F.col("progress").cast("double"), F.lit(None)).alias("progress"),
    )
    return F.to_json(event, {"ignoreNullFields": "false"})


def _first_us(event: str) -> int:
    """The time of an event, which is the first field of its JSON."""
    return int(event[event.index(":") + 1 : event.index(",")])


def _ordered(events: Sequence[str]) -> list[tuple]:
    """Events by time and id, an unknown id last."""
    told = (tuple(json.loads(e).values()) for e in events)
    return sorted(told, key=lambda e: (e[0], e[1] is None, e[1] or 0))


class _TaskLife(StatefulProcessor):
    """One task: what it is, and the events the watermark has not passed.

    It takes rows and not frames: a task has few of them, and each frame and
    each call for state costs more than the steps over its rows.
    """

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", _TASK)
        self.waiting = handle.getValueState("waiting", _WAITING)

    def _wait(self, first: int, events: list[str]) -> None:
        self.waiting.update((first, events))
        _timer(self.handle, first)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, events = self.waiting.get() or (None, [])
        new = [r[2] for r in rows]
        low = min(map(_first_us, new))
        if first is None or low < first:
            self._wait(low, [*events, *new])
        else:
            self.waiting.update((first, [*events, *new]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        _, events = self.waiting.get() or (None, [])
        due = [e for e in events if _first_us(e) <= passed]
        status, end, error, progress, refused = self.task.get() or (None, None, None, None, 0)
        for ts, _, new, message, done in _ordered(due):
            if status in FINISHED:
                refused += 1
                continue
            status, end = new, ts if new in FINISHED else end
            error = error if message is None else message
            progress = progress if done is None else float(done)
        if due:
            self.task.update((status, end, error, progress, int(refused)))
            later = [e for e in events if _first_us(e) > passed]
            if later:
                self._wait(min(map(_first_us, later)), later)
            else:
                self.waiting.clear()
            yield Row(id=key[0], task_status=status, end_us=end, error_msg=error, progress=progress, refused=int(refused))
        if status in FINISHED and len(due) == len(events):
            if passed >= end + self.retention_ms * 1000:
                self.task.clear()
            else:
                self.handle.registerTimer(end // 1000 + self.retention_ms + 1)

    def close(self) -> None:
        pass


def task_life(log: DataFrame, lateness: str = LATENESS, retention_ms: int = RETENTION_MS) -> DataFrame:
    """The state of every task, told anew whenever the watermark passes events of it.

    `log` is a stream of `id, ts, event_id, task_status, error_msg, progress`.
    Events count in the order of `ts, event_id`. D and F end a task: they set
    its end date, and events after them change nothing and are counted in
    `refused`. Errors and progress are kept until a new one is given. A task's
    state goes `retention_ms` after its end, events later than the lateness and
    without a time are dropped. Write with output mode update or append; the
    last row of an id holds.
    """
    timed = log.where(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    events = timed.select("id", "ts", packed_event().alias("event"))
    schema = (
        T.StructType([log.schema["id"]]).add("task_status", "string").add("end_us", "long").add("error_msg", "string")
        .add("progress", "double").add("refused", "long")
    )
    told = events.groupBy("id").transformWithState(
        _TaskLife(retention_ms), outputStructType=schema, outputMode="Update", timeMode="EventTime"
    )
    return told.select("id", "task_status", F.timestamp_micros("end_us").alias("end_date"), "error_msg", "progress", "refused")
