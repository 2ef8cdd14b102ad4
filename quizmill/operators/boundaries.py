"""Ends of sentences that aren't: abbreviations learned from a corpus by how they go with periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, let, sentences, unnested
from .scan import scanned

#: Fixed values of the published statistic: chance of a period after an abbreviation, and the score from which a type is one.
ABBREVIATED, ACCEPT = 0.99, 0.3
#: A word: a letter, then letters, digits and periods.
WORD = r"^[^\x00-\x40\x5B-\x60\x7B-\x7F][^\x00-\x2D\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$"
#: So many abbreviations may stand in an expression; so many may be broadcast; more are joined by shuffle.
LISTED_ROWS, BROADCAST_ROWS = 10_000, 300_000


def _type(word: Column) -> Column:
    """A word without its last period, A-Z in lower case."""
    return F.translate(F.regexp_replace(word, r"\.$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def abbreviation_score(n: Column, ended: Column, share: Column, kind: Column) -> Column:
    """How surely a type is an abbreviation: the log-likelihood ratio of its periods against the corpus' share, for types of few letters, with periods inside, and seldom without a period."""
    plain = ended * F.log(share) + (n - ended) * F.log(1 - share)
    close = ended * F.log(F.lit(ABBREVIATED)) + (n - ended) * F.log(F.lit(1 - ABBREVIATED))
    periods = F.length(kind) - F.length(F.replace(kind, F.lit("."), F.lit("")))
    letters = (F.length(kind) - periods).cast("double")
    return -2 * (plain - close) * F.exp(-letters) * (periods + 1) * F.pow(letters, -(n - ended).cast("double"))


def abbreviations(docs: DataFrame, text_col: str) -> DataFrame:
    """(type, score) of the types that a corpus uses as abbreviations. Counts are of all texts; a word is one row a task before the shuffle, and is looked at once."""
    every = docs.select(F.explode(F.split(F.coalesce(text_col, F.lit("")), f"{SPACE}+")).alias("word"))
    words = every.groupBy("word").agg(F.count("*").alias("n")).where(F.col("word").rlike(WORD))
    types = words.groupBy(_type(F.col("word")).alias("type")).agg(F.sum("n").alias("n"), F.sum(F.when(F.endswith("word", F.lit(".")), F.col("n")).otherwise(0)).alias("ended"))
    total = types.agg((F.sum("ended") / F.sum("n")).alias("share"))  # one row
    scored = types.join(F.broadcast(total)).where((F.col("ended") > 0) & (F.col("share") < 1))
    return scored.select("type", abbreviation_score(F.col("n"), F.col("ended"), F.col("share"), F.col("type")).alias("score")).where(F.col("score") >= ACCEPT)


def learned_sentences(docs: DataFrame, key: str, text_col: str, known: DataFrame | None = None, piece: int = 4096) -> DataFrame:
    """(key, sent_ix, sentence): sentences as the pattern of functions.text cuts them, but not after an abbreviation; the parts that so come together are joined by a space.

    known: abbreviations(type), those of docs themselves if not given. Up to LISTED_ROWS of them are told to the tasks in the plan, and each text is cut where it is, without a shuffle.
    With more, numbers are scanned by pieces of a text. Keys must be unique; texts without sentences and null keys have no rows.
    """
    short = abbreviations(docs, text_col).select("type") if known is None else known.select("type").distinct()
    listed = [r["type"] for r in short.limit(LISTED_ROWS + 1).collect()]
    if len(listed) <= LISTED_ROWS:
        return _cut_in_place(docs.where(F.col(key).isNotNull()), key, text_col, listed)
    few = short.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    parts = unnested(docs, F.transform(sentences(F.col(text_col)), lambda s, i: F.struct(i.cast("long").alias("ix"), s.alias("part"))), "ix", F.col(key).alias("key_"))
    last = F.element_at(F.split("part", f"{SPACE}+"), -1)
    ended = parts.where("key_ is not null").withColumn("type", F.when(F.endswith(last, F.lit(".")) & last.rlike(WORD), _type(last)))
    joined = ended.join(F.broadcast(short.withColumn("open", F.lit(True))) if few else short.withColumn("open", F.lit(True)), "type", "left")
    # a part that ends a sentence closes its number: the number of a part is how many were closed before it
    placed = joined.select("key_", "ix", "part", F.col("open").isNull().cast("long").alias("closes"), F.floor(F.col("ix") / piece).alias("piece_"))
    counted = scanned(placed, ["key_"], "piece_", ["ix"], F.col("closes"), "closed")
    rows = counted.groupBy("key_", (F.col("closed") - F.col("closes")).alias("sent_ix")).agg(F.array_sort(F.collect_list(F.struct("ix", "part"))).alias("p"))
    return rows.select(F.col("key_").alias(key), "sent_ix", F.array_join(F.transform("p", lambda x: x["part"]), " ").alias("sentence"))


def _cut_in_place(docs: DataFrame, key: str, text_col: str, short: list[str]) -> DataFrame:
    """The same by an expression over each text: its parts in one string again, with a line end where a sentence ends. No part has a line end after a mark that ends it, or it would have been cut there."""
    last = lambda s: F.regexp_extract(F.substring_index(s, " ", -1), f"[^{SPACE[1:-1]}]+$", 0)
    opens = lambda w: F.endswith(w, F.lit(".")) & w.rlike(WORD) & _type(w).isin(short)
    closed = F.transform(sentences(F.col(text_col)), lambda s: F.concat(s, F.when(let(last(s), opens), " ").otherwise("\n")))
    # what stands after the last part belongs to no sentence
    whole = let(F.array_join(closed, ""), lambda t: F.substring(t, F.lit(1), F.length(t) - 1))
    rows = F.transform(F.filter(F.split(whole, r"(?<=[.!?])\n"), lambda s: s != ""), lambda s, i: F.struct(i.cast("long").alias("sent_ix"), s.alias("sentence")))
    return unnested(docs, rows, "sent_ix", key)
