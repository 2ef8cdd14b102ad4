"""Reads behind lists and detail pages, and guarded inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def page(rows: DataFrame, order: list[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of 1 to 100 rows (20 if not said) from an offset of 0 or more. The order needs a last key that is unique."""
    size = max(1, min(100, 20 if limit is None else limit))
    return rows.orderBy(*order).offset(max(0, offset or 0)).limit(size)


def owned(rows: DataFrame, owner: str, user) -> DataFrame:
    return rows.where(F.col(owner) == F.lit(user))


def children(parents: DataFrame, rows: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """parents with `items`, the values of their rows in order (an empty list if there are none)."""
    lists = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]).alias("items"))
    return parents.join(lists, key, "left")


def may_add(parents: DataFrame, rows: DataFrame, key: str, order: str, cap: Column, config: Config = DEFAULT) -> DataFrame:
    """(key, n, cap, allowed, next_order, collides): whether another child fits, its place (count + 1), and whether that place is taken already."""
    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.collect_set(order).alias("orders"))
    bounded = F.greatest(F.lit(1), F.least(F.lit(config.max_target), F.coalesce(cap, F.lit(config.max_target))))
    out = parents.select(key, bounded.cast("long").alias("cap")).join(per, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    following = (F.col("n") + 1).alias("next_order")
    taken = F.coalesce(F.array_contains("orders", (F.col("n") + 1).cast(dict(rows.dtypes)[order])), F.lit(False))
    return out.select(key, "n", "cap", (F.col("n") < F.col("cap")).alias("allowed"), following, taken.alias("collides"))


def first_copies(rows: DataFrame, content: Column, key: str) -> DataFrame:
    """(content_key, first, copies): one row for each content."""
    return rows.groupBy(content.alias("content_key")).agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def recent_keys(access: DataFrame, key: str, at: str, config: Config = DEFAULT) -> DataFrame:
    """(key, last_access, place): the most recently used keys that a cache of its size holds. A top-n, not a global window."""
    last = access.groupBy(key).agg(F.max(at).alias("last_access")).orderBy(F.desc("last_access"), key).limit(config.style_cache_size)
    return last.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("last_access"), key)).cast("long"))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache.select(key), key, "left_anti")
