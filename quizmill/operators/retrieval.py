"""Which chunks go into the context of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import context


def limit(questions: int, config: Config = DEFAULT) -> int:
    return min(max(1, config.chunks_per_question * questions), config.max_context_chunks)


def spread(n: Column, k: int) -> Column:
    """Places of at most k evenly spread items out of n; all of them if there are no more than k. Halves round to even: one division of whole numbers, as a rounded step would miss them."""
    some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.greatest(F.lit(0), F.least((n - 1).cast("int"), F.rint(i * (n - 1) / F.lit(max(1, k - 1))).cast("int")))))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(some)


def spread_sample(chunks: DataFrame, k: int, count: str = "n_chunks", at: str = "chunk_ix") -> DataFrame:
    """The rows of an exploded chunk table at spread places: the count stands in each row, so nothing is shuffled."""
    return chunks.where(F.array_contains(spread(F.col(count), k), F.col(at)))


def top_by(rows: DataFrame, group: list[str], score: Column, at: str, k: int) -> DataFrame:
    """The k best rows of each group, with `place`, their place among these in document order. Ties go to the earlier row."""
    best = Window.partitionBy(*group).orderBy(score.desc(), F.col(at))
    kept = rows.withColumn("rank_", F.row_number().over(best)).where(F.col("rank_") <= k)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(at))).drop("rank_")


def nearest_l2(rows: DataFrame, distance: str, at: str, k: int, radius: float | None) -> DataFrame:
    """The k rows of least squared distance; with a radius those of the 2k nearest within it, or the first k rows if none is."""
    if radius is None:
        return rows.orderBy(distance, at).limit(k)
    near = rows.orderBy(distance, at).limit(2 * k)
    inside = near.where(F.col(distance) <= radius).orderBy(distance, at).limit(k).withColumn("found_", F.lit(True))
    first = rows.orderBy(at).limit(k).withColumn("found_", F.lit(False))
    both = inside.unionByName(first)  # 2k rows at most
    any_inside = F.max("found_").over(Window.partitionBy(F.lit(1)))
    return both.withColumn("any_", any_inside).where(F.col("found_") == F.col("any_")).drop("found_", "any_")


def contexts(chunks: DataFrame, key: str, outline: Column | None = None) -> DataFrame:
    """(key, context): a document's kept chunks in order. Each document has at most max_context_chunks of them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_ix", "text"))), lambda x: x["text"])
    return chunks.groupBy(key).agg(context(outline if outline is not None else F.lit(None).cast("string"), ordered).alias("context"))
