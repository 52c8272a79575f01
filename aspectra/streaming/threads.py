"""Sessions that expire by themselves: a stream of requests becomes one of closed threads.

State per user is the open thread and the requests that the watermark has not
passed yet. A timer takes those in the order of time as soon as it has, however
they were split into batches, and another closes the thread when its time to
live is over: it is given out and all of the user's state is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType

from aspectra.plans.constants import SESSION_TTL_SECONDS
from aspectra.session import ship_code

#: Stateful processing needs this provider.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MICROS = 1_000_000


class ThreadProcessor(StatefulProcessor):
    """Rows (user, at: microseconds, tie) in; rows (user, first tie, started, ended, n) out, one per closed thread."""

    def __init__(self, ttl_seconds: int, tie_type: str):
        self.ttl, self.tie_type = ttl_seconds * MICROS, tie_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, tie {self.tie_type}")
        self.thread = handle.getValueState("open", f"first {self.tie_type}, started long, ended long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if key[0] is None:
            return
        added = [(r["at"], r["tie"]) for r in rows]
        if added:
            self.waiting.appendList(added)
            self._remind(min(at for at, _ in added))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in held if r[0] <= upto]
        left = held[len(ready) :]
        thread = self.thread.get() if self.thread.exists() else None
        for at, tie in ready:
            if thread and at - thread[2] >= self.ttl:
                yield self._closed(key, thread)
                thread = None
            first, started, _, n = thread or (tie, at, at, 0)
            thread = (first, started, at, n + 1)
        if thread and upto >= thread[2] + self.ttl:  # whatever comes later is too late for it
            yield self._closed(key, thread)
            thread = None
        if thread:
            self.thread.update(thread)
            self._remind(thread[2] + self.ttl)
        else:
            self.thread.clear()
        if left:
            self.waiting.put(left)
            self._remind(left[0][0])
        else:
            self.waiting.clear()

    def _closed(self, key: Any, thread: tuple) -> Row:
        first, started, ended, n = thread
        return Row(user=key[0], first=first, started=_time(started), ended=_time(ended), n=n)

    def _remind(self, at: int) -> None:
        """A timer for the first millisecond not before a time."""
        self.handle.registerTimer(-(-at // 1000))


def _time(micros: int) -> datetime:
    return datetime.fromtimestamp(micros // MICROS, UTC).replace(microsecond=micros % MICROS)


def closed_threads(requests: DataFrame, user: str, ts: str, tie: str, ttl: int = SESSION_TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(user, first, started, ended, n) for each thread of a stream of requests once its time to live is over.

    A gap of ttl seconds or more ends a thread, as in the batch operator. Requests
    later than the watermark are left out; those of a null user have no thread.
    The session has to name RocksDB as its state store, see STATE_STORE. Time
    zone: `ts` is a moment, or is read in the session's zone.
    """
    ship_code(requests.sparkSession)
    kinds: dict[str, DataType] = {f.name: f.dataType for f in requests.schema.fields}
    tie_type, user_type = kinds[tie].simpleString(), kinds[user].simpleString()
    timed = requests.select(F.col(user).alias("user"), F.col(ts).cast("timestamp").alias("_ts"), F.col(tie).alias("tie")).where("_ts is not null")
    rows = timed.withWatermark("_ts", late).withColumn("at", F.unix_micros("_ts"))
    return rows.groupBy("user").transformWithState(
        ThreadProcessor(ttl, tie_type),
        f"user {user_type}, first {tie_type}, started timestamp, ended timestamp, n long",
        outputMode="Append",
        timeMode="EventTime",
    )
