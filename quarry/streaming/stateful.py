"""Streams with state of their own: segments of logs, and leases of jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.logs import BOUNDARY

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """Processors with timers need a state store that keeps what does not fit in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class Segmenter(StatefulProcessor):
    """Numbers the segments and parts of a log's lines. Of an open log three numbers are kept; with ``idle_ms``, of one that has been silent for so long none."""

    def __init__(self, most: int, idle_ms: int | None):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "segment long, n long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        segment, n, timer = self.open.get() if self.open.exists() else (0, 0, 0)
        lines = pd.concat(rows).sort_values("line_no", kind="stable")
        number = segment + lines["line"].fillna("").str.contains(BOUNDARY, regex=True).cumsum()
        # lines of the segment so far: those of earlier batches count for the one that goes on
        place = number.groupby(number).cumcount() + (number == segment) * n
        yield pd.DataFrame({"log_id": key[0], "line_no": lines["line_no"], "line": lines["line"], "segment": number, "part": place // self.most})
        if self.idle_ms is not None:
            silent = int(lines["at"].max().timestamp() * 1000) + self.idle_ms
            if silent > timer:
                if timer:
                    self.handle.deleteTimer(timer)
                timer = silent
                self.handle.registerTimer(timer)
        self.open.update((int(number.iloc[-1]), int(place.iloc[-1]) + 1, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def segmented(stream: DataFrame, most: int = 250, time: str | None = None, idle_seconds: int = 86_400, late: str = "0 seconds") -> DataFrame:
    """A stream of lines (log_id, line_no, line), in whatever batches, with their segment and part.

    A log's lines come in the order of their numbers from batch to batch. ``time`` names a
    column with the time of a line; a log without one for ``idle_seconds`` (by the watermark) is
    closed, forgotten, and numbered from the beginning if it goes on. Without it none is closed.
    """
    with_state_store(stream.sparkSession)
    log = stream.schema["log_id"]
    out = T.StructType([log, T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType()), T.StructField("segment", T.LongType()), T.StructField("part", T.LongType())])
    columns = [stream["log_id"], stream["line_no"].cast("long").alias("line_no"), stream["line"]]
    if time is None:
        return stream.select(*columns).groupBy("log_id").transformWithStateInPandas(Segmenter(most, None), out, "Append", "None")
    lines = stream.select(*columns, stream[time].alias("at")).withWatermark("at", late)
    return lines.groupBy("log_id").transformWithStateInPandas(Segmenter(most, 1000 * idle_seconds), out, "Append", "EventTime")


_MOVES = "job_id long, worker_id string, status string, attempts long, at timestamp"


class Leases(StatefulProcessor):
    """Who works on a job, until when, and for the how-many-th time. A lease that is not renewed ends by a timer of event time."""

    def __init__(self, lease_ms: int, max_attempts: int):
        self.lease_ms, self.max_attempts = lease_ms, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "worker string, until long, attempts long")

    def _move(self, key, worker, status: str, attempts: int, ms: int) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "worker_id": [worker], "status": [status], "attempts": [attempts], "at": [pd.Timestamp(ms, unit="ms")]})

    def _free(self, until: int) -> None:
        if until:
            self.handle.deleteTimer(until)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        worker, until, attempts = self.lease.get() if self.lease.exists() else (None, 0, 0)
        done = False
        for row in pd.concat(rows).sort_values(["at", "action"], kind="stable").itertuples():
            now = int(row.at.timestamp() * 1000)
            if until and now >= until:  # it ended between two rows of one batch
                yield self._move(key, worker, "queued" if attempts < self.max_attempts else "failed", attempts, until)
                self._free(until)
                worker, until = None, 0
            if row.action == "claim" and worker is None and attempts < self.max_attempts and not done:
                worker, attempts, until = row.worker_id, attempts + 1, now + self.lease_ms
                self.handle.registerTimer(until)
                yield self._move(key, worker, "processing", attempts, now)
            elif row.action == "heartbeat" and row.worker_id == worker:
                self._free(until)
                until = now + self.lease_ms
                self.handle.registerTimer(until)
            elif row.action == "finish" and row.worker_id == worker:
                self._free(until)
                yield self._move(key, worker, "completed", attempts, now)
                worker, until, done = None, 0, True
        if done:
            self.lease.clear()
        else:
            self.lease.update((worker, until, attempts))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        worker, until, attempts = self.lease.get() if self.lease.exists() else (None, 0, 0)
        if until and expiredTimerInfo.getExpiryTimeInMs() == until:
            again = attempts < self.max_attempts
            if again:
                self.lease.update((None, 0, attempts))
            else:
                self.lease.clear()
            yield self._move(key, worker, "queued" if again else "failed", attempts, until)

    def close(self) -> None:
        pass


def leased(stream: DataFrame, lease_seconds: int = 900, max_attempts: int = 3, late: str = "0 seconds") -> DataFrame:
    """What becomes of jobs, from what workers do (job_id, worker_id, action: claim, heartbeat or finish, at).

    The first claim of a free job gets it; a claim of a job that is held changes nothing. When
    the watermark passes the end of a lease, the job is queued again, or failed after ``max_attempts``.
    """
    with_state_store(stream.sparkSession)
    steps = stream.select("job_id", "worker_id", "action", "at").withWatermark("at", late)
    return steps.groupBy("job_id").transformWithStateInPandas(Leases(1000 * lease_seconds, max_attempts), _MOVES, "Append", "EventTime")
