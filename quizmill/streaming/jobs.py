"""Time-driven operators as Structured Streaming: file intake, sweeps of stale jobs, rate windows and progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, RUNNING, TERMINAL, Config
from ..functions.text import clean, word_count
from ..operators.lifecycle import extraction_status


def extracted(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A stream of (doc_id, text, pages) with cleaned text, words and status: no state, so any trigger will do."""
    cleaned = docs.withColumn("text", clean(F.col("text"), config))
    return cleaned.withColumn("words", word_count(F.col("text"))).withColumn("status", extraction_status(F.col("text"), F.col("pages"), config))


def stale_jobs(heartbeats: DataFrame, config: Config = DEFAULT, delay: str = "10 seconds") -> DataFrame:
    """(job, status, at) for heartbeats(job, at, status): a job ends with its first terminal status, or as failed_timeout once the watermark is stale_after_s past its last heartbeat.

    State is a timestamp and a mark for each job. A job that has ended keeps its mark until the watermark is stale_after_s past its
    last heartbeat, so that late or repeated heartbeats don't open it anew; rows older than the watermark never come.
    """
    wait = config.stale_after_s * 1000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (job,) = key
        if state.hasTimedOut:
            last, over = state.get
            if over:
                state.remove()
                return
            # the watermark may still let heartbeats in that are later than the last
            state.update((last, True))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + wait)
            yield pd.DataFrame({"job": [job], "status": ["failed_timeout"], "at": [pd.Timestamp(last, unit="us")]})
            return
        (last, over), ended = (state.get if state.exists else (None, False)), None
        for b in batches:
            for at, status in sorted(zip(b["at"], b["status"], strict=True)):
                micros = int(at.value // 1000)
                last = micros if last is None else max(last, micros)
                if status in TERMINAL and ended is None:
                    ended = (status, at)
        if last is None:
            return
        state.update((last, over or ended is not None))
        state.setTimeoutTimestamp(max(last // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        if ended and not over:
            yield pd.DataFrame({"job": [job], "status": [ended[0]], "at": [ended[1]]})

    rows = heartbeats.where(F.col("status").isin(*RUNNING, *TERMINAL)).withWatermark("at", delay)
    return rows.groupBy("job").applyInPandasWithState(step, "job long, status string, at timestamp", "last long, over boolean", "append", GroupStateTimeout.EventTimeTimeout)


def request_rates(events: DataFrame, key: str, at: str, tokens: str, config: Config = DEFAULT, slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Requests and tokens in sliding windows, with late events up to the watermark."""
    window = F.window(at, f"{config.rate_window_s} seconds", slide)
    out = events.withWatermark(at, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens"))
    return out.select(key, F.col("w.start").alias("start"), "requests", "tokens", ((F.col("requests") <= config.rate_requests) & (F.col("tokens") <= config.rate_tokens)).alias("allowed"))


def job_progress(updates: DataFrame, key: str, at: str, done: str, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """The furthest progress and last heartbeat of each job in each interval."""
    out = updates.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), key).agg(F.max(done).alias("done"), F.max(at).alias("heartbeat"))
    return out.select(key, F.col("w.start").alias("start"), "done", "heartbeat")
