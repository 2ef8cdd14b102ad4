"""Style profiles of reference papers, and outlines of long documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import content_key, first_words, numbered, sampled_questions
from ..providers import mapped
from .serving import cache_misses

#: Fixed value: seconds for a profile.
STYLE_LIMIT_S = 10.0


def style_profiles(papers: DataFrame, cache: DataFrame | None = None, name: str | tuple[str, ...] = "mock", config: Config = DEFAULT, limit_s: float | None = STYLE_LIMIT_S) -> DataFrame:
    """(content_key, profile) of papers(text) whose content isn't cached yet: equal papers are profiled once; no questions, no answer in time or any failure: null."""
    keyed = papers.select(content_key(F.col("text")).alias("content_key"), numbered(sampled_questions(F.col("text"), config)).alias("asked")).dropDuplicates(["content_key"])
    todo = keyed if cache is None else cache_misses(keyed, cache, "content_key")
    made = mapped(todo.where("asked <> ''"), "asked", "raw", "summarize", name, 1, limit_s=limit_s)
    return todo.select("content_key").join(made, "content_key", "left").select("content_key", F.when(F.col("raw").isNotNull(), first_words(F.col("raw"), config)).alias("profile"))


def outlines(chunks: DataFrame, key: str, name: str | tuple[str, ...] = "mock", config: Config = DEFAULT) -> DataFrame:
    """(key, outline) for documents with more than outline_min_chunks chunks: summaries of the first ones, blank ones dropped, in order."""
    first = chunks.where((F.col("n_chunks") > config.outline_min_chunks) & (F.col("chunk_ix") < config.outline_max_chunks))
    made = mapped(first.select(key, "chunk_ix", "text"), "text", "summary", "summarize", name, config.batch_validation_max)
    lists = made.where("summary is not null and summary <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_ix", "summary"))).alias("s"))
    return lists.select(key, F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("Chunk "), (i + 1).cast("string"), F.lit(": "), x["summary"])), "\n").alias("outline"))
