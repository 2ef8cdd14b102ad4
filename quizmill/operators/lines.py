"""Cleaning of texts that come as one row a line, however many lines a text has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import strip
from .scan import scanned


def paragraph_lines(lines: DataFrame, key: str, at: str, line: str, config: Config = DEFAULT, piece_lines: int = 10_000) -> DataFrame:
    """(key, at, place, paragraph, piece): the lines that cleaning keeps, with their number, their paragraph's number (both from 1) and what they add to the clean text.

    Lines are stripped, blank ones go, and of equal lines of a text the first stays. A line shorter than short_line_chars goes on its paragraph after a space, another starts one after a
    blank line. The pieces of a text joined in order are its clean text. Numbers are scanned by pieces of a text of piece_lines lines, which hand on their counts: no task
    and no row holds a text. Null lines are blank; rows without a key belong to no text and go. `at` must be unique in a text and not negative.
    """
    stripped = lines.select(F.col(key).alias("key_"), F.col(at).cast("long").alias("at_"), strip(F.coalesce(F.col(line), F.lit(""))).alias("line_")).where("line_ <> '' and key_ is not null")
    first = stripped.groupBy("key_", "line_").agg(F.min("at_").alias("at_")).withColumn("block_", F.floor(F.col("at_") / piece_lines))
    placed = scanned(first, ["key_"], "block_", ["at_"], F.lit(1).cast("long"), "place")
    short = F.length("line_") < config.short_line_chars
    between = F.when(F.col("place") == 1, "").when(short, " ").otherwise("\n\n")
    numbered = scanned(placed, ["key_"], "block_", ["at_"], ((F.col("place") == 1) | ~short).cast("long"), "paragraph")
    piece = F.concat(between, F.regexp_replace("line_", r"[ \t]+", " "))
    return numbered.select(F.col("key_").alias(key), F.col("at_").alias(at), "place", "paragraph", piece.alias("piece"))
