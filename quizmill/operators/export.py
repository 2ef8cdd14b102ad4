"""Tests as lines of a paper, as JSON, and as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import OPTION_LABELS


def paper_lines(questions: DataFrame, key: str) -> DataFrame:
    """(key, section, ord, line) of questions(key, sort_order, question, options, correct_option, explanation): questions with options A to D, answers, explanations.

    One pass over the rows: each gives its seven lines. ord orders the lines of a section.
    """
    number = F.concat(F.lit("Q"), F.col("sort_order").cast("string"), F.lit(". "))
    line = lambda section, k, text: F.struct(F.lit(section).alias("section"), (F.col("sort_order").cast("long") * 10 + k).alias("ord"), text.alias("line"))
    option = lambda x: F.concat(F.lit(f"  {x}. "), F.coalesce(F.try_element_at("options", F.lit(x)), F.lit("")))
    rows = [line(1, 0, F.concat(number, F.col("question"))), *[line(1, k + 1, option(x)) for k, x in enumerate(OPTION_LABELS)]]
    rows += [line(2, 0, F.concat(number, F.col("correct_option"))), line(3, 0, F.concat(number, F.col("explanation")))]
    return questions.select(key, F.inline(F.array(*rows)))


def labelled_lines(labels: Column, texts: Column) -> Column:
    """Option lines of a labelled list: every label stands."""
    return F.zip_with(labels, texts, lambda k, v: F.concat(F.lit("  "), F.coalesce(k, F.lit("")), F.lit(". "), F.coalesce(v, F.lit(""))))


EXPORTED = ["question", "options", "correct_option", "explanation", "difficulty", "topic_tag", "validation_result", "quality_score"]


def as_json(questions: DataFrame, key: str, *header: str) -> DataFrame:
    """(key, json): a document for each test, its questions in order."""
    one = F.struct("sort_order", *EXPORTED)
    per = questions.groupBy(key, *header).agg(F.array_sort(F.collect_list(one), lambda a, b: F.signum(a["sort_order"] - b["sort_order"]).cast("int")).alias("q"))
    mcqs = F.transform("q", lambda x: F.struct(*[x[c].alias(c) for c in EXPORTED]))
    return per.select(key, F.to_json(F.struct(F.col(key).alias("test_id"), *header, F.size("q").alias("questions_generated"), mcqs.alias("mcqs"))).alias("json"))


def write_exports(documents: DataFrame, key: str, path: str) -> None:
    """A folder with a text file for each row of as_json, by key; exports of other tests stay. For a few tests: for many see streaming.merged.ReplacedTable."""
    documents.select(key, "json").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)


def replace_questions(questions: DataFrame, key: str, path: str) -> None:
    """Writes each test's rows in place of its former ones, a folder a test; other tests' rows stay. For many tests see streaming.merged.ReplacedTable."""
    numbered = questions.withColumn("sort_order", F.row_number().over(Window.partitionBy(key).orderBy("sort_order")))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
