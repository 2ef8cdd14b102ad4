"""The whole way from documents to the questions of a test, as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, TOPICS, Config
from ..functions.chunking import chunks, exploded
from ..functions.parsing import mcqs
from ..functions.text import clean, final_score, unnested
from ..operators.lifecycle import extraction_status, ineligible
from ..operators.nearest import relevant_sample
from ..operators.retrieval import contexts, limit, spread_sample
from ..operators.selection import select, with_topics
from ..operators.style import outlines
from ..providers import asked_until, candidates_wanted, mapped
from ..sources.tables import table, topics


def pages_of(n_chars: Column) -> Column:
    """The driver's documents have no pages: 1800 characters count as one."""
    return F.ceil(n_chars / 1800).cast("int")


def eligible(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, text): cleaned texts that questions can be generated from."""
    # a generator, so that the filter doesn't make Catalyst clean each text again
    status = lambda t: extraction_status(t, pages_of(F.col("n_chars")), config)
    checked = F.transform(F.array(clean(F.col("text"), config)), lambda t: F.struct(t.alias("text"), ineligible(status(t), t, config).isNull().alias("fine")))
    return unnested(docs, F.filter(checked, lambda c: c["fine"]), "fine", "doc_id").select("doc_id", "text")


def requests(docs: DataFrame, target: int, config: Config = DEFAULT, name: str | tuple[str, ...] = "mock", goal: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, context) of eligible documents: chunks at spread places, under the outline of a long document if the settings want one.

    goal: what each request asks for, by its doc_id (see functions.text.retrieval_text); with it chunks are those whose embeddings by the provider are most similar to the goal's.
    """
    parts = exploded(docs, chunks(F.col("text"), config), "doc_id")
    k = limit(target, config)
    held = spread_sample(parts, k) if goal is None else relevant_sample(parts, docs.select("doc_id", goal(F.col("doc_id")).alias("goal")), "doc_id", "goal", k, name)
    if not config.use_global_outline:
        return contexts(held, "doc_id")
    return contexts(held.join(outlines(parts, "doc_id", name, config), "doc_id", "left"), "doc_id", F.first("outline"))


def judged(found: DataFrame, name: str | tuple[str, ...] = "mock", config: Config = DEFAULT) -> DataFrame:
    """Candidates with the verdicts of a provider: critique and the score that counts."""
    shown = found.withColumn("shown_", F.to_json(F.struct("question", "options", "correct_option", "explanation")))
    told = mapped(shown, "shown_", "verdict_", "validate", name, config.batch_validation_max)
    v = F.col("verdict_")
    return told.withColumn("critique", v["critique"]).withColumn("quality_score", final_score(v["quality_score"], v["critique"], v["is_valid"])).drop("shown_", "verdict_")


def generated(spark: SparkSession, folder: str, target: int = 5, config: Config = DEFAULT, name: str | tuple[str, ...] = "mock", level: str | None = None, style: str | None = None, goal: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, sort_order, question, correct_option, difficulty, topic_id, quality_score, mode): the provider's questions, by its own verdicts.

    Answers without questions are asked for again; what can't be read gives no candidate.
    """
    slugs = [s for s, _ in TOPICS]
    asked = requests(eligible(table(spark, folder, "documents"), config), target, config, name, goal)
    raw = asked_until(asked, "context", (candidates_wanted(target, config), slugs, level, style), name, config.generation_attempts)
    kept = with_topics(select(judged(mcqs(raw, "raw", slugs, "doc_id"), name, config), "doc_id", F.lit(target)), topics(spark))
    return kept.select("doc_id", "sort_order", "question", "correct_option", "difficulty", "topic_id", "quality_score", "mode")
