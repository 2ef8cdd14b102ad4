"""From candidates to the questions of a test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ANSWER_LABELS, OPTION_LABELS
from ..functions.text import difficulty_rank, faulty, strip


def shaped(question: Column, options: Column, answer: Column) -> Column:
    """A stem of at least 8 characters, options A to D that aren't blank, an answer among them (none counts as A)."""
    filled = F.forall(F.array(*map(F.lit, OPTION_LABELS)), lambda k: strip(F.coalesce(F.try_element_at(options, k), F.lit(""))) != "")
    letter = F.upper(strip(F.when(F.coalesce(answer, F.lit("")) == "", "A").otherwise(answer)))
    return F.coalesce((F.length(strip(F.coalesce(question, F.lit("")))) >= 8) & filled & letter.isin(OPTION_LABELS), F.lit(False))


def payload_fault(answer: Column, level: Column, labels: Column, asked: Column) -> Column:
    """The first rule that a question sent in breaks; null if it breaks none."""
    expected = F.slice(F.array(*map(F.lit, ANSWER_LABELS)), 1, F.greatest(F.size(labels), F.lit(1)))
    return (
        F.when(~F.coalesce(answer.isin(ANSWER_LABELS), F.lit(False)), "correct_option")
        .when(~F.coalesce(level.isin("easy", "medium", "hard"), F.lit(False)), "difficulty")
        .when(~F.size(labels).between(4, 5) | (labels != expected), "options")
        .when(~F.coalesce(asked.between(1, 20), F.lit(False)), "num_questions")
    )


def select(candidates: DataFrame, key: str, target: Column | int, phrases: list[str] | None = None) -> DataFrame:
    """Kept candidates with `mode` and `sort_order`.

    Well-shaped ones without a faulty critique, medium before easy before hard; only if a key has none of these, its well-shaped ones by score. Strict
    mode may keep fewer than asked for. One shuffle by key: both windows share it. Ties go by cand_ix.
    """
    good = candidates.where(shaped(F.col("question"), F.col("options"), F.col("correct_option")))
    good = good.withColumn("pass_", ~faulty(F.col("critique"), phrases)).withColumn("any_", F.max("pass_").over(Window.partitionBy(key)))
    good = good.where(F.col("pass_") == F.col("any_"))
    score = F.coalesce(F.col("quality_score").try_cast("double"), F.lit(0.5))
    order = Window.partitionBy(key).orderBy(F.when(F.col("any_"), 0.0).otherwise(-score), difficulty_rank(F.col("difficulty")), "cand_ix")
    ranked = good.withColumn("sort_order", F.row_number().over(order).cast("long")).where(F.col("sort_order") <= target)
    return ranked.withColumn("mode", F.when(F.col("any_"), "strict").otherwise("quality_fallback")).drop("pass_", "any_")


def modes(keys: DataFrame, selected: DataFrame, key: str, target: Column) -> DataFrame:
    """(key, mode, kept, status) for every key; one without rows is empty and failed."""
    counts = selected.groupBy(key).agg(F.first("mode").alias("mode"), F.count("*").alias("kept"))
    out = keys.select(key, target.alias("target_")).join(counts, key, "left")
    kept = F.coalesce("kept", F.lit(0))
    return out.select(key, F.coalesce("mode", F.lit("empty")).alias("mode"), kept.alias("kept"), F.when(kept == 0, "failed").when(kept >= F.col("target_"), "completed").otherwise("partial").alias("status"))


def with_topics(rows: DataFrame, topics: DataFrame, tag: str = "topic_tag") -> DataFrame:
    """rows with topic_id; blank and unknown tags get the first topic. topics(topic_id, slug, sort_order) has a row for each of a few topics."""
    first = topics.agg(F.min(F.struct("sort_order", "slug", "topic_id")).alias("m")).select(F.col("m.topic_id").alias("default_"))
    found = topics.select(F.col("slug").alias("slug_"), "topic_id")
    joined = rows.withColumn("slug_", F.lower(strip(F.coalesce(F.col(tag), F.lit(""))))).join(found, "slug_", "left")
    return joined.join(F.broadcast(first)).withColumn("topic_id", F.coalesce("topic_id", "default_")).drop("slug_", "default_")


def first_success(attempts: DataFrame, key: str, attempt: str, n: str, tokens: str, tries: int) -> DataFrame:
    """(key, attempt, n, tokens): the first of at most `tries` attempts that gave something, and the tokens of all attempts up to it."""
    tried = attempts.where(F.col(attempt) < tries)
    good = F.min(F.when(F.col(n) > 0, F.col(attempt)))
    per = tried.groupBy(key).agg(good.alias("good_"), F.array_sort(F.collect_list(F.struct(attempt, n, tokens))).alias("all_"))
    used = F.filter("all_", lambda a: F.col("good_").isNull() | (a[attempt] <= F.col("good_")))
    total = F.aggregate(used, F.lit(0).cast("long"), lambda s, a: s + a[tokens].cast("long"))
    got = F.coalesce(F.get(F.filter("all_", lambda a: a[attempt] == F.col("good_")), F.lit(0))[n], F.lit(0)).cast("long")
    return per.select(key, F.col("good_").cast("long").alias("attempt"), got.alias("n"), total.alias("tokens"))
