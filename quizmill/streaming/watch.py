"""Jobs that are watched by timers of their own: state in a store on disk, one entry a job, that goes when the job has been over for long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from ..config import DEFAULT, RUNNING, TERMINAL, Config

#: The setting and the store that timers and lists of a key need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "job long, status string, at timestamp, beats long, longest_gap_s double"


def with_store(spark: SparkSession) -> SparkSession:
    """The session, whose streams keep their state in RocksDB: on disk with a changelog, so that its size isn't bounded by an executor's memory."""
    spark.conf.set(*STORE)
    return spark


class Watch(StatefulProcessor):
    """One job: its last sign of life, its time-out, the times of its heartbeats that are still needed, and its end."""

    def __init__(self, stale_after_s: int, beats: int):
        self.stale_after_s, self.most = stale_after_s, beats

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, wait long, n long, gap long")
        self.over = handle.getValueState("over", "status string")
        self.recent = handle.getListState("recent", "at long")

    def _clear(self) -> None:
        self.last.clear()
        self.over.clear()
        self.recent.clear()

    def _timer(self, ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)

    def _told(self, job: int, status: str, at: int) -> pd.DataFrame:
        _, _, n, gap = self.last.get()
        return pd.DataFrame({"job": [job], "status": [status], "at": [pd.Timestamp(at, unit="us")], "beats": [n], "longest_gap_s": [gap / 1e6]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        (job,) = key
        last, wait, n, gap = self.last.get() if self.last.exists() else (None, self.stale_after_s * 1000, 0, 0)
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        ended = None
        for batch in rows:
            for at, status, timeout in sorted(zip(batch["at"], batch["status"], batch["timeout_s"], strict=True), key=lambda r: (r[0], r[1])):
                micros = int(at.value // 1000)
                if last is None or micros >= last:  # the newest heartbeat says how long to wait for the next
                    last, wait = micros, self.stale_after_s * 1000 if pd.isna(timeout) else int(timeout) * 1000
                n += 1
                recent.append(micros)
                if status in TERMINAL and (ended is None or (micros, status) < ended):
                    ended = (micros, status)
        recent.sort()
        gap = max([gap, *(b - a for a, b in zip(recent, recent[1:], strict=False))])
        self.last.update((last, wait, n, gap))
        self.recent.put([(x,) for x in recent[-self.most :]])
        self._timer(max(last // 1000 + wait, timerValues.getCurrentWatermarkInMs() + 1))
        if ended and not self.over.exists():
            self.over.update((ended[1],))
            yield self._told(job, ended[1], ended[0])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        (job,) = key
        last, wait, _, _ = self.last.get()
        if self.over.exists():  # over for as long as late heartbeats may come: nothing of the job is left
            self._clear()
            return
        self.over.update(("failed_timeout",))
        self._timer(timerValues.getCurrentWatermarkInMs() + wait)
        yield self._told(job, "failed_timeout", last)

    def close(self) -> None:
        pass


def watched_jobs(heartbeats: DataFrame, config: Config = DEFAULT, delay: str = "10 seconds", beats: int = 8) -> DataFrame:
    """(job, status, at, beats, longest_gap_s) for a stream heartbeats(job, at, status, timeout_s): a job's end, once.

    A job ends with its first terminal status, or as failed_timeout once the watermark is its own time-out past its last heartbeat: timeout_s of that heartbeat, stale_after_s where that is null.
    beats counts its heartbeats so far; longest_gap_s is the longest time between neighbours among the `beats` newest of each batch. Other states, null jobs and times are left out.
    A job that is over keeps its mark for one more time-out, so that late or repeated heartbeats don't open it anew; then its state goes. Every job has one timer. The stream needs
    with_store(spark), goes on from its checkpoint after a failure, and a job's state is an entry in the store, so a hot job costs no more than its rows.
    """
    rows = heartbeats.where(F.col("status").isin(*RUNNING, *TERMINAL) & F.col("job").isNotNull() & F.col("at").isNotNull()).withWatermark("at", delay)
    rows = rows.select(F.col("job").cast("long").alias("job"), "at", "status", F.col("timeout_s").cast("long").alias("timeout_s"))
    return rows.groupBy("job").transformWithStateInPandas(Watch(config.stale_after_s, beats), StructType.fromDDL(OUT), "Append", "EventTime")
