"""The nearest vectors of many queries at once, and the chunks that are relevant to each request."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..providers import embedded
from .retrieval import spread

#: Queries of a tile; tiles that may be broadcast (8 MB of 64 components each, at most); pieces that vectors are dealt to beyond that; vectors that a tile is multiplied with at once.
TILE, TILES, SALTS, BLOCK = 1024, 16, 64, 1024
#: Places that similarities are compared to: what differs less is a tie.
DIGITS = 9


def _usable(vector: Column, size: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def best_places(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, ties to the smaller id."""
    k = min(k, sims.shape[1])
    row, column = np.nonzero(sims >= np.partition(sims, -k, axis=1)[:, [-k]])
    order = np.lexsort((ids[column], -sims[row, column], row))
    row, column = row[order], column[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept]


def nearest_of_each(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "vec_id", column: str = "embedding", itself: bool = True) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k vectors of largest cosine similarity for each query, of all vectors; ties go to the smaller id. Ids are whole numbers.

    Queries are tiles of about TILE rows. Vectors stay where they are: a task multiplies each of its batches with each tile and gives at most k rows a query on, of which the k best a task are shuffled. Tiles are
    broadcast while there are at most TILES; more meet the batches by a shuffle that is salted, so that no tile's work is a single task's. Exact: there is no index and no sample.
    Null ids, and vectors that are null, hold null or non-finite components or have another length than the longest query's, are left out.
    itself: whether a vector with the query's id counts. Of several vectors for a query's id the smallest counts; repeated ids of vectors give a row each. Fewer than k vectors give fewer rows.
    """
    longest = queries.agg(F.max(F.size(column)).alias("n")).first()["n"] or 0
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(column).cast("array<double>").alias("v")).where(F.col("q").isNotNull() & _usable(F.col("v"), longest))
    asked = asked.groupBy("q").agg(F.min("v").alias("v"))
    tiles = max(1, -(-asked.count() // TILE))
    tiled = asked.withColumn("tile", F.pmod(F.xxhash64("q"), F.lit(tiles)).cast("int")).groupBy("tile").agg(F.collect_list("q").alias("ids"), F.flatten(F.collect_list("v")).alias("goal"))
    rows = vectors.select(F.col(vector_id).cast("long").alias("id"), F.col(column).alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v"), longest))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                ends = np.array([0, len(b)], np.int32)
                values = _matrix(b.column(1), longest).ravel()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, b.column(0)), pa.ListArray.from_arrays(ends * longest, values)], ["own", "values"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                own, ids = (batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in (0, 2))
                v, goal = (np.asarray(batch.column(c)[at].values, np.float64).reshape(-1, longest) for c in (1, 3))
                best = [part for first in range(0, len(own), BLOCK) for part in [some(own[first : first + BLOCK], v[first : first + BLOCK], ids, goal)] if len(part[0])]
                if best:
                    row, near, sim = map(np.concatenate, zip(*best, strict=True))
                    order = np.lexsort((near, -sim, row))
                    row, near, sim = row[order], near[order], sim[order]
                    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row[kept]]), pa.array(near[kept]), pa.array(sim[kept])], ["q", "id", "similarity"])

    def some(own: np.ndarray, v: np.ndarray, ids: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of goal, id, similarity) of the k nearest of a few vectors: what is held for all pairs at once is TILE times BLOCK numbers."""
        lengths = np.sqrt((goal * goal).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))
        sims = np.round((goal @ v.T) / (lengths + 1e-12), DIGITS)
        if not itself:
            sims[ids[:, None] == own] = -np.inf
        row, place = best_places(sims, own, k)
        real = sims[row, place] > -np.inf
        return row[real], own[place[real]], sims[row, place][real]

    blocks = rows.mapInArrow(packed, "own array<long>, values array<double>").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    if tiles <= TILES:
        met = blocks.join(F.broadcast(tiled), "tile")
    else:
        salted = blocks.withColumn("salt", F.pmod(F.xxhash64(F.col("own")[0]), F.lit(SALTS)))
        met = salted.join(tiled.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["tile", "salt"])
    found = met.select("own", "values", "ids", "goal").mapInArrow(scored, "q long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("id").alias(vector_id), "similarity", "rank")


def relevant_sample(chunks: DataFrame, requests: DataFrame, key: str, goal: str, k: int, name: str | tuple[str, ...] = "mock") -> DataFrame:
    """The chunks(key, n_chunks, chunk_ix, text) that go into the context of each of requests(key, goal): the k most similar to its own goal text; all of a document of at most k.

    Goals are embedded once each, chunks only where there is something to choose. A document for which the provider gives no embedding of a chunk or of the goal, or whose request is missing, gets chunks at
    spread places. Ties go to the earlier chunk.
    """
    goals = embedded(requests.where(F.col(goal).isNotNull()).select(F.col(goal).alias("goal_")).distinct(), "goal_", name).withColumnRenamed("embedding", "target_")
    wanted = requests.select(key, F.col(goal).alias("goal_")).join(goals, "goal_", "left").select(key, "target_")
    scored = embedded(chunks.where(F.col("n_chunks") > k), "text", name).join(wanted, key, "left").withColumn("sim_", F.round(cosine(F.col("embedding"), F.col("target_")), DIGITS))
    document = Window.partitionBy(key)
    placed = scored.withColumn("lost_", F.max(F.col("sim_").isNull()).over(document)).withColumn("rank_", F.row_number().over(document.orderBy(F.desc_nulls_last("sim_"), "chunk_ix")))
    kept = placed.where(F.when(F.col("lost_"), F.array_contains(spread(F.col("n_chunks"), k), F.col("chunk_ix"))).otherwise(F.col("rank_") <= k))
    return chunks.where(F.col("n_chunks") <= k).unionByName(kept.select(*chunks.columns))
