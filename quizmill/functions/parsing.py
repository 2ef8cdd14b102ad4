"""Tolerant readers of model output: JSON goes through VARIANT, so one odd element doesn't spoil its list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ANSWER_LABELS, OPTION_LABELS
from .text import critique_score, difficulty, strip


def unfenced(raw: Column) -> Column:
    """Without a code fence around it: the first line if it starts one, the last if it is nothing but one."""
    body = strip(F.coalesce(raw, F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(body, r"^```[^\n]*(?:\n|$)", ""), r"(?:^|\n)[ \t]*```[ \t]*$", "")
    return F.when(F.startswith(body, F.lit("```")), strip(inner)).otherwise(body)


def items(raw: Column, field: str) -> Column:
    """array<variant> of an object's field or of a top-level list; what can't be read is empty."""
    parsed = F.try_parse_json(unfenced(raw))
    listed = F.coalesce(F.try_variant_get(parsed, f"$.{field}", "array<variant>"), F.try_variant_get(parsed, "$", "array<variant>"))
    return F.coalesce(listed, F.expr("cast(array() as array<variant>)"))


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def mcqs(rows: DataFrame, raw_col: str, topics: list[str], *keep: str) -> DataFrame:
    """(kept columns, cand_ix, question, options, correct_option, explanation, difficulty, topic_tag), a row for each object in the list.

    Options that aren't an object are blank A to D; missing ones are blank, others stay. No answer is A, an unknown difficulty medium, an unknown topic the
    first one. Numbers are read as their text.
    """
    each = rows.select(*keep, F.posexplode_outer(items(F.col(raw_col), "mcqs")).alias("at", "v")).where(_is_object(F.col("v")))
    v = F.col("v")
    given = F.coalesce(F.try_variant_get(v, "$.options", "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    blank = F.create_map(*[x for k in OPTION_LABELS for x in (F.lit(k), F.lit(""))])
    options = F.map_zip_with(given, blank, lambda _, a, b: F.coalesce(a, b, F.lit("")))
    answer = F.upper(strip(_text(v, "$.correct_option")))
    tag = F.lower(strip(_text(v, "$.topic_tag")))
    return each.select(
        *keep,
        F.col("at").cast("long").alias("cand_ix"),
        _text(v, "$.question").alias("question"),
        options.alias("options"),
        F.when(answer == "", "A").otherwise(answer).alias("correct_option"),
        _text(v, "$.explanation").alias("explanation"),
        difficulty(F.try_variant_get(v, "$.difficulty", "string")).alias("difficulty"),
        F.when(tag.isin(topics), tag).otherwise(topics[0]).alias("topic_tag"),
    )


def verdicts(raw: Column, expected: Column) -> Column:
    """array<struct<is_valid, quality_score, critique>> of the expected length. A missing item is valid with 0.5; output that isn't a list makes all invalid with 0.5."""
    parsed = F.try_variant_get(F.try_parse_json(unfenced(raw)), "$", "array<variant>")
    bounded = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    def one(i: Column) -> Column:
        v = F.get(parsed, i)
        valid = F.when(parsed.isNull(), False).otherwise(F.coalesce(F.try_variant_get(v, "$.is_valid", "boolean"), F.lit(True)))
        score = F.when(parsed.isNull(), 0.5).otherwise(bounded(F.coalesce(F.try_variant_get(v, "$.quality_score", "double"), F.lit(0.5))))
        critique = F.when(parsed.isNull(), "").otherwise(_text(v, "$.critique"))
        return F.struct(valid.alias("is_valid"), score.alias("quality_score"), critique.alias("critique"))

    return F.when(expected > 0, F.transform(F.sequence(F.lit(0), expected - 1), one)).otherwise(F.expr("cast(array() as array<struct<is_valid:boolean,quality_score:double,critique:string>>)"))


def vision_mcqs(rows: DataFrame, raw_col: str, level: Column, topics: list[str], *keep: str) -> DataFrame:
    """(kept columns, cand_ix, question, options, correct_option, difficulty, topic_tag) of output with labelled option lists.

    A question needs 4 or 5 options labelled A to E; an answer that isn't one of them is the first label; the difficulty is the one asked for.
    """
    each = rows.select(*keep, level.alias("level_"), F.posexplode_outer(items(F.col(raw_col), "questions")).alias("at", "v")).where(_is_object(F.col("v")))
    v = F.col("v")
    listed = F.coalesce(F.try_variant_get(v, "$.options", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    pairs = F.transform(listed, lambda o: F.struct(F.upper(strip(_text(o, "$.label"))).alias("label"), strip(_text(o, "$.text")).alias("text")))
    pairs = F.filter(pairs, lambda o: o["label"].isin(ANSWER_LABELS))
    each = each.withColumn("pairs", F.array_sort(pairs)).where(F.size("pairs").between(4, 5) & (F.size(F.array_distinct(F.col("pairs.label"))) == F.size("pairs")))
    answer = F.upper(strip(_text(v, "$.correct_option")))
    tag = F.lower(strip(_text(v, "$.topic_tag")))
    return each.select(
        *keep,
        F.col("at").cast("long").alias("cand_ix"),
        strip(_text(v, "$.question")).alias("question"),
        F.map_from_entries("pairs").alias("options"),
        F.when(F.array_contains(F.col("pairs.label"), answer), answer).otherwise(F.col("pairs.label")[0]).alias("correct_option"),
        F.col("level_").alias("difficulty"),
        F.when(tag.isin(topics), tag).otherwise(topics[0]).alias("topic_tag"),
    )


def scored(score: Column, critique: Column) -> Column:
    return F.coalesce(score, critique_score(critique))
