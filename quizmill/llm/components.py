"""Connected components of a link table, by contraction with shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import written


def connected(links: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, root) for every node of links; nodes are linked transitively and share one root.

    Each round maps every node to that of itself and its neighbours which has the least hash under the round's
    seed, and replaces the links by those between the images. A random order lets long chains shrink by a constant
    factor a round. Null ends and self links are dropped; repeated links don't matter. Nothing is collected but a count.
    """
    edges = written(links.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "links")
    maps, seed = [], 0
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), c.alias("x"))  # noqa: B023, E731
        step = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m"))
        step = written(step.select("u", F.least("m", rank(F.col("u"))).getField("x").alias("to")), "step")
        maps.append(step)
        edges = edges.join(step, "u").select(F.col("to").alias("u"), F.col("v").alias("w"))
        edges = edges.join(step.withColumnRenamed("u", "w"), "w").select("u", F.col("to").alias("v"))
        edges = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
        seed += 1
    if not maps:
        return links.sparkSession.createDataFrame([], edges.select(F.col("u").alias("node"), F.col("u").alias("root")).schema)
    out = maps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for step in maps[1:]:
        out = out.join(step.select(F.col("u").alias("root"), F.col("to").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
