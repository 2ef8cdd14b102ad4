"""Batches of page images, and the token budget of a run."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..config import DEFAULT, Config
from ..providers import maker, some_seen

#: Pages in a batch, tokens that a model takes, share of them at which a run ends.
BATCH_PAGES, MODEL_TOKENS, BUDGET_SHARE = 3, 200_000, 0.8


def batch_of(page: Column) -> Column:
    return F.floor(page / BATCH_PAGES).cast("long")


def within_budget(batches: DataFrame, key: str, at: str, tokens: str, limit: float = MODEL_TOKENS * BUDGET_SHARE) -> DataFrame:
    """The batches of each run that are made: up to and with the one that brings its tokens to the limit. `spent` is the sum so far."""
    before = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(tokens).over(before), F.lit(0))
    return batches.withColumn("spent", spent).where(F.col("spent") < limit).withColumn("spent", F.col("spent") + F.col(tokens))


class Throttle:
    """Waits until the tokens of the last window leave room for another call."""

    def __init__(self, tokens: int, window_s: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.tokens, self.window_s, self.clock, self.sleep, self.spent = tokens, window_s, clock, sleep, deque()

    def wait(self) -> None:
        while True:
            now = self.clock()
            while self.spent and self.spent[0][0] <= now - self.window_s:
                self.spent.popleft()
            if not self.spent or sum(n for _, n in self.spent) < self.tokens:
                return
            self.sleep(self.spent[0][0] + self.window_s - now)

    def add(self, n: int) -> None:
        self.spent.append((self.clock(), n))


def seen_run(images: DataFrame, key: str, n: int, name: str | tuple[str, ...] = "mock", config: Config = DEFAULT, limit: float = MODEL_TOKENS * BUDGET_SHARE, throttle: Callable[[], Throttle] | None = None) -> DataFrame:
    """(key, batch, raw, tokens) of images(key, page, content): the questions that a provider sees on each three pages, in order.

    An answer without questions is asked for once more; one with some is reviewed, and the review stands if it has some. A run ends when
    its tokens reach the limit. A key's pages are read as a stream, three at a time. Failed calls cost no tokens and give no answer.

    There are as many tasks as cores, so that all run at once, and each has its share of the rate: together they keep within it, though one whose runs end early leaves its share unused.
    """
    tasks = images.sparkSession.sparkContext.defaultParallelism
    make, throttled = maker(name), throttle or (lambda: Throttle(max(1, config.rate_tokens // tasks), config.rate_window_s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, slow = make(), throttled()

        def call(method: str, *args) -> tuple[str | None, int]:
            slow.wait()
            try:
                raw, tokens = getattr(model, method)(*args)
            except Exception:  # noqa: BLE001  any failure of a provider
                return None, 0
            slow.add(tokens)
            return raw, tokens

        def answer(pages: list[bytes]) -> tuple[str | None, int]:
            raw, tokens = call("see", pages, n)
            if not some_seen(raw):
                raw, more = call("see", pages, n)
                tokens += more
            if some_seen(raw):
                better, more = call("review", raw)
                raw, tokens = better if some_seen(better) else raw, tokens + more
            return raw, tokens

        now, held, at, spent = None, [], 0, 0
        rows: list[tuple] = []

        def close() -> None:
            nonlocal held, at, spent
            if held and spent < limit:
                raw, tokens = answer(held)
                spent += tokens
                rows.append((now, at, raw, tokens))
            held, at = [], at + 1

        for b in batches:
            for k, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != now:
                    close()
                    now, at, spent = k, 0, 0
                held.append(content or b"")
                if len(held) == BATCH_PAGES:
                    close()
            yield _answers(rows, b.schema.field(0), key)
            rows = []
        close()
        if rows:
            yield _answers(rows, kind, key)

    kind = pa.field(key, pa.string() if isinstance(images.schema[key].dataType, StringType) else pa.int64())
    order = images.select(F.col(key).cast("string" if pa.types.is_string(kind.type) else "long").alias(key), "page", "content").repartition(tasks, key).sortWithinPartitions(key, "page")
    made = [StructField("batch", LongType()), StructField("raw", StringType()), StructField("tokens", LongType())]
    return order.select(key, "content").mapInArrow(run, StructType([order.schema[key], *made]))


def _answers(rows: list[tuple], kind: pa.Field, key: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind.type, pa.int64(), pa.string(), pa.int64()], strict=True)], [key, "batch", "raw", "tokens"])
