"""When calls may start under a limit of so many in a window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .scan import scanned


def admitted(calls: DataFrame, key: str, at: str, tie: str, config: Config = DEFAULT, piece_s: int = 3600) -> DataFrame:
    """calls with start_at, the time at which each may start, and wait_us, how long it waits for that.

    The calls of a key start in order of time and tie; one starts at its own time, or when rate_window_s have passed since the start of the rate_requests-th call before it,
    whichever is later. Later calls are judged by the delayed starts. Unlike a limiter that forgets its window after a wait, this one never lets more than
    rate_requests start within a window. Calls without a key or time have null start and wait and hold up no others; ties with equal `tie` are taken in any order.

    Every rate_requests-th call depends on the one before it alone, so the start of the q-th of such a class is q windows after the largest of (own time - place * window) up to it:
    a running maximum. Ranks and maxima are scanned by pieces of piece_s seconds, so that a key with very many calls is spread over as many tasks as it has pieces.
    """
    if config.rate_requests < 1:
        raise ValueError("rate_requests must be at least 1")
    window = F.lit(config.rate_window_s * 1_000_000)
    named = calls.select(F.col(key).alias("key_"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_"), F.col(tie).alias("tie_"), F.struct(*[F.col(f"`{c}`") for c in calls.columns]).alias("call_"))
    known = F.col("key_").isNotNull() & F.col("at_").isNotNull()
    ranked = scanned(named.where(known).withColumn("piece_", F.floor(F.col("at_") / (piece_s * 1_000_000))), ["key_"], "piece_", ["at_", "tie_"], F.lit(1).cast("long"), "rank_")
    turn = F.floor((F.col("rank_") - 1) / config.rate_requests).cast("long")
    classed = ranked.withColumn("class_", (F.col("rank_") - 1) % config.rate_requests).withColumn("turn_", turn)
    latest = scanned(classed, ["key_", "class_"], "piece_", ["turn_"], F.col("at_") - F.col("turn_") * window, "most_", F.max, F.greatest)
    start = F.col("most_") + F.col("turn_") * window
    told = latest.select("call_", start.alias("start_"), (start - F.col("at_")).alias("wait_"))
    none = F.lit(None).cast("long")
    every = told.unionByName(named.where(~known).select("call_", none.alias("start_"), none.alias("wait_")))
    return every.select(*[F.col(f"call_.`{c}`") for c in calls.columns], F.timestamp_micros("start_").alias("start_at"), F.col("wait_").alias("wait_us"))
