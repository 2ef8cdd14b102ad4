"""Vectors of texts from the words they hold, weighted by how rare these are in the corpus: all of it in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept
from .text import SPACE

#: Components of a vector, and places that similarities are rounded to.
DIM, DIGITS = 64, 9
#: So many words may be broadcast (some tens of MB): those that most texts hold. What occurs of the others is joined by shuffle.
BROADCAST_ROWS = 300_000


def lower_words(text: Column) -> Column:
    """Words between white space, A-Z in lower case."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(folded, f"{SPACE}+"), "")


def _place(word: Column) -> Column:
    """The component of a word: the first 7 hex digits of its md5 modulo DIM."""
    return (F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("long") % DIM).cast("int")


def _sign(word: Column) -> Column:
    """1 or -1, by the last hex digit of its md5."""
    return F.when(F.substring(F.md5(word), 32, 1) < "8", 1.0).otherwise(-1.0)


def word_weights(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, at, weight, band): the component of each word of a corpus, its signed weight log((1 + texts) / (1 + texts that hold it)) + 1, and the binary logarithm of how many hold it."""
    n = texts.count()
    holding = texts.select(F.explode(F.array_distinct(lower_words(F.col(text_col)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return holding.select("word", _place(F.col("word")).alias("at"), (_sign(F.col("word")) * (F.log(F.lit(1.0 + n) / (1 + F.col("n"))) + 1)).alias("weight"), F.floor(F.log2("n")).cast("int").alias("band"))


def _components(texts: DataFrame, weights: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep, at, value): sums before the shuffle, so at most DIM rows a text and task go through it.

    The words that most texts hold are broadcast, by bands from the most frequent on while they are BROADCAST_ROWS at most, so no frequent word is shuffled, however many words the corpus has.
    """
    words = texts.select(*keep, F.explode(lower_words(F.col(text_col))).alias("word"))
    bands = sorted(weights.groupBy("band").agg(F.count("*").alias("n")).collect(), reverse=True)  # a row for each power of two
    least, n = 64, 0
    for r in bands:
        if n + r["n"] > BROADCAST_ROWS:
            break
        least, n = r["band"], n + r["n"]
    told = weights.select("word", "at", "weight")
    if n == sum(r["n"] for r in bands):
        found = words.join(F.broadcast(told), "word")
    else:
        met = words.join(F.broadcast(told.where(weights["band"] >= least)), "word", "left")
        rest = met.where("at is null").select(*keep, "word").join(told.where(weights["band"] < least), "word")
        found = met.where("at is not null").unionByName(rest)
    return found.groupBy(*keep, "at").agg(F.sum("weight").alias("value"))


def weighted_vectors(texts: DataFrame, weights: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """(key, embedding array<double>) of unit length, of each text that holds a word of the corpus. Words that the corpus doesn't have add nothing. Keys must be unique and not null."""
    parts = _components(texts, weights, text_col, key)
    held = parts.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("m"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    component = lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)) / F.greatest(F.col("length"), F.lit(1e-12))
    return held.select(*key, F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), component).alias("embedding"))


def similarities(texts: DataFrame, goals: DataFrame, key: list[str], of: str, text_col: str, goal_col: str) -> DataFrame:
    """texts with `similarity`, the cosine of their weighted vectors with that of their own goal: goals(of, goal_col) are joined by the column `of`.

    The corpus that weights words is the texts. A text without words, or whose goal has no word of the corpus, has similarity 0. One vector a goal, not one a text, is joined; each text's vector exists only as sums by component.
    """
    weights = kept(word_weights(texts, text_col), "words")  # read for goals, for texts and for the count of bands
    aims = _components(goals, weights, goal_col, [of]).withColumnRenamed("value", "aim")
    aims = kept(aims, "aims")
    few = aims.count() <= BROADCAST_ROWS  # else a component of a goal that many texts share would be one key of a shuffle
    aims = F.broadcast(aims) if few else aims
    lengths = aims.groupBy(of).agg(F.sqrt(F.sum(F.col("aim") * F.col("aim"))).alias("aim_length"))
    keep = list(dict.fromkeys([*key, of]))
    parts = _components(texts, weights, text_col, keep).join(aims, [of, "at"], "left")
    sums = parts.groupBy(*keep).agg(F.sum(F.coalesce(F.col("value") * F.col("aim"), F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    cosines = sums.join(lengths, of, "left").select(*keep, F.coalesce(F.col("dot") / (F.col("length") * F.col("aim_length") + 1e-12), F.lit(0.0)).alias("cosine_"))
    return texts.join(cosines, keep, "left").withColumn("similarity", F.round(F.coalesce("cosine_", F.lit(0.0)), DIGITS) + F.lit(0.0)).drop("cosine_")
