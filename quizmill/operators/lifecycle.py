"""States of documents and tests: eligibility, progress, sweeps and merges of change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, RUNNING, TERMINAL, Config
from ..functions.text import age_s, short_error, strip, word_count


def upload_status(filename: Column, pages: Column, asked: Column, config: Config = DEFAULT) -> Column:
    """What becomes of an upload: the first fault, rejected for too many pages, or processing."""
    return (
        F.when(~F.coalesce(F.lower(filename).endswith(".pdf"), F.lit(False)), "not_pdf")
        .when(asked.isNotNull() & ~asked.between(1, config.max_target), "bad_num_questions")
        .when(pages.isNull(), "unreadable")
        .when(pages > config.max_pdf_pages, "rejected")
        .otherwise("processing")
    )


def extraction_status(cleaned: Column, pages: Column, config: Config = DEFAULT) -> Column:
    return F.when(pages > config.max_pdf_pages, "rejected").when(F.length(cleaned) < config.min_extraction_chars, "extraction_failed").otherwise("ready")


def ineligible(status: Column, cleaned: Column, config: Config = DEFAULT) -> Column:
    """Why questions can't be generated from a document, the first reason; null if they can."""
    return (
        F.when(status.isNull(), "not found")
        .when(status == "rejected", "rejected")
        .when(status != "ready", "not ready")
        .when(strip(F.coalesce(cleaned, F.lit(""))) == "", "no text")
        .when(word_count(cleaned) < config.min_extraction_words, "too few words")
    )


def conflicts(requests: DataFrame, tests: DataFrame, keys: list[str]) -> DataFrame:
    """requests for which a test of the same keys is under way."""
    return requests.join(tests.where(F.col("status").isin(RUNNING)).select(*keys), keys, "left_semi")


def denominator(total: Column, target: Column) -> Column:
    return F.coalesce(F.nullif(total, F.lit(0)), F.nullif(target, F.lit(0)))


def progress(done: Column, total: Column, target: Column) -> Column:
    """Two places, halves to even; null without a denominator."""
    d = denominator(total, target)
    return F.when(d.isNotNull(), F.bround(F.coalesce(done, F.lit(0)) / d, 2))


def list_message(done: Column, total: Column, target: Column) -> Column:
    """For lists; null without a denominator."""
    return F.concat(F.coalesce(done, F.lit(0)).cast("string"), F.lit(" of "), denominator(total, target).cast("string"), F.lit(" questions created"))


def status_message(status: Column, done: Column, total: Column, target: Column, age: Column, timeout: Column) -> Column:
    """For one test; the status itself without a denominator."""
    counted = list_message(done, total, target)
    slow = F.when(age > timeout / 2, " (this may take a while for large documents)").otherwise("")  # fixed values
    busy = F.concat(F.lit("Generating... usually under 1 minute. "), counted, slow)
    return F.coalesce(F.when(status.isin(RUNNING), busy).otherwise(counted), status)


def ticked(done: Column, total: Column, ticks: Column) -> Column:
    """Estimated progress after some ticks: never the total itself."""
    return F.when(total <= 1, F.lit(0)).when(ticks <= 0, done).otherwise(F.least(done + ticks, total - 1))


def stale(status: Column, updated: Column, created: Column, now: Column, timeout: Column, config: Config = DEFAULT, running: list[str] = RUNNING) -> Column:
    return status.isin(running) & (age_s(F.coalesce(updated, created), now) > F.coalesce(timeout, F.lit(config.stale_after_s)))


def swept(rows: DataFrame, now: Column, timeout: Column, failed: str = "failed_timeout", running: list[str] = RUNNING) -> DataFrame:
    """rows(status, updated_at, created_at) with stale ones failed: those of the running states whose last sign of life is too long ago."""
    gone = stale(F.col("status"), F.col("updated_at"), F.col("created_at"), now, timeout, running=running)
    return rows.withColumn("status", F.when(gone, failed).otherwise(F.col("status")))


def cancelled(status: Column, owner: Column, user: Column) -> Column:
    return F.when(status.isin(RUNNING) & (owner == user), "failed").otherwise(status)


def failure(reason: Column) -> Column:
    return F.struct(F.lit("failed").alias("status"), short_error(reason).alias("failure_reason"), F.lit(0).alias("progress_mcq"))


def latest(log: DataFrame, key: str, at: str, tie: str, status: str | None = None) -> DataFrame:
    """The last row of each key in an append-only log; with a status column the first terminal row holds against later ones.

    max_by keeps one row a key and task before the shuffle, so a hot key costs no more than others.
    """
    names = [c for c in log.columns if c != key]
    row = F.struct(*names)
    order = F.struct(at, tie)
    last = F.max_by(row, order)
    if status:
        ended = F.col(status).isin(TERMINAL)
        first_end = F.min_by(F.when(ended, row), F.when(ended, order))
        last = F.coalesce(first_end, last)
    return log.groupBy(key).agg(last.alias("r")).select(key, *[F.col(f"r.`{c}`").alias(c) for c in names])


def patched(base: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """base with each field that a patch gives; null fields of a patch leave the old value."""
    fields = [c for c in patches.columns if c != key]
    new = patches.select(key, *[F.col(c).alias(f"new_{c}") for c in fields])
    joined = base.join(new, key, "left")
    return joined.select(*[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def rate_limited(events: DataFrame, key: list[str], at: str, tokens: Column, config: Config = DEFAULT, split: bool = False) -> DataFrame:
    """events with the requests and tokens of the window that ends with each, and whether they are within the limits. An event exactly a window ago is out.

    An event adds itself at its time and takes itself away a window later, so a window's counts are running sums: the work doesn't depend on how many events a window holds. Tokens are whole numbers.
    split: for few keys with very many events. Time is cut into pieces of a window's length; an event leaves in the piece after its own, and what leaves there is counted from that
    piece's start: twice the rows, but as many tasks as there are pieces.
    """
    length = config.rate_window_s * 1_000_000
    held = events.select(*[F.col(k).alias(f"key{i}_") for i, k in enumerate(key)], F.unix_micros(F.col(at).cast("timestamp")).alias("at_"), tokens.alias("spent_"), F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("event_"))
    # events without a time are each other's window
    piece = F.floor(F.col("at_") / length) if split else F.when(F.col("at_").isNotNull(), F.lit(0).cast("long"))
    enters = F.struct(piece.alias("piece_"), F.col("at_"), F.lit(1).alias("sign_"), F.col("event_"))
    leaves = F.struct((piece + (1 if split else 0)).alias("piece_"), (F.col("at_") + length).alias("at_"), F.lit(-1).alias("sign_"), F.lit(None).cast(held.schema["event_"].dataType).alias("event_"))
    both = F.when(F.col("at_").isNull(), F.array(enters)).otherwise(F.array(enters, leaves))
    keys = [f"key{i}_" for i in range(len(key))]
    rows = held.select(*keys, "spent_", F.inline(both))
    part = Window.partitionBy(*keys, "piece_").orderBy("at_")
    until, whole = part.rangeBetween(Window.unboundedPreceding, Window.currentRow), part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def held_by(value: Column) -> Column:
        running = F.sum(value * F.col("sign_")).over(until)
        return running + F.sum(F.when(F.col("sign_") < 0, value).otherwise(0)).over(whole) if split else running

    sums = rows.withColumn("requests", held_by(F.lit(1).cast("long"))).withColumn("tokens", held_by(F.coalesce("spent_", F.lit(0)))).withColumn("known_", held_by(F.col("spent_").isNotNull().cast("long")))
    out = sums.where(F.col("sign_") > 0).select(*[F.col(f"event_.`{c}`") for c in events.columns], "requests", F.when(F.col("known_") > 0, F.col("tokens")).alias("tokens"))
    return out.withColumn("allowed", (F.col("requests") <= config.rate_requests) & (F.col("tokens") <= config.rate_tokens))


def throttled(rows: DataFrame, done: str, total: str, config: Config = DEFAULT) -> DataFrame:
    """Progress reports worth writing: every few pages, and the last."""
    return rows.where((F.col(done) % config.progress_every_pages == 0) | (F.col(done) == F.col(total)))


def screen_progress(status: Column, done: Column, total: Column) -> Column:
    """Per cent for a progress bar; halves go up."""
    share = F.when(total > 0, F.floor(100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), done / total)) + 0.5)).otherwise(0)
    return F.when(status.isin("completed", "ready"), 100).when(status.isin("failed", "failed_timeout", "extraction_failed"), 0).when(status == "partial", share).otherwise(F.least(F.lit(95), share)).cast("long")
