"""Quality scores: ridge regression on random Fourier features of document statistics, then isotonic calibration.

The random features approximate a Gaussian kernel over standardised statistics of the whole text. Each partition of labelled rows
sums its part of the normal equations, apart for each fold; the sums are added up in steps, so no task and not the driver gets more than some matrices of fixed size.
The calibration is fitted on counts in fixed bins of raw scores that come from the equations of the other folds. All labelled rows count: there is no sample.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from .stage import sliced, table, unique_ids, unwrapped, whole, with_broadcast_if, written

#: Random features, kernel width in standard deviations per square root of a statistic, ridge penalty per row, bins of the calibration.
FEATURES, WIDTH, PENALTY, BINS, SEED = 256, 1.5, 1e-4, 1000, 7
LOW, HIGH = -0.5, 1.5
#: Folds of the calibration; tasks of the last step that adds up matrices (the step before has as many as a shuffle).
FOLDS, LAST = 2, 8
#: So many ids of rejected rows may be broadcast (some tens of MB); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
MARKS = b"!*#$%&|.,=:"


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; those of an empty or null one are zeros."""
    data = (text or "").encode()
    n = len(data)
    if not n:
        return [0.0] * N_STATISTICS
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts / n
    present = share[share > 0]
    words = data.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    kinds = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = data.split(b"\n")
    top = max(kinds.values(), default=0)
    letters = share[65:91].sum() + share[97:123].sum() + share[128:].sum()
    return [
        math.log1p(n),
        math.log1p(len(words)),
        share[97:123].sum(),
        share[65:91].sum(),
        share[48:58].sum(),
        share[128:].sum(),
        share[9:14].sum() + share[32],
        share[10],
        letters,
        float(-(present * np.log2(present)).sum()),
        lengths.mean(),
        lengths.std(),
        lengths.max(),
        len(kinds) / m,
        len(kinds) / m**0.8,
        top / m,
        pairs / m,
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        *(share[c] * n / m for c in MARKS),
    ]


N_STATISTICS = 19 + len(MARKS)


class RandomFeatures:
    """sqrt(2/D) cos(Wx + b) of standardised x, then x itself and a constant."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(size=(len(mean), FEATURES)) / (WIDTH * math.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * math.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([math.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b), x, np.ones((len(x), 1))])


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing means of the bins by pooling adjacent violators; bins without rows take the mean of the pool below (or above)."""
    pools: list[list[float]] = []  # rows, ones, bins
    for t, o in zip(total.tolist(), ones.tolist(), strict=True):
        pools.append([t, o, 1])
        while len(pools) > 1 and (pools[-1][0] == 0 or pools[-2][0] == 0 or pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]):
            t, o, k = pools.pop()
            pools[-1] = [pools[-1][0] + t, pools[-1][1] + o, pools[-1][2] + k]
    return np.concatenate([np.full(int(k), o / t if t else 0.5) for t, o, k in pools])


class Model:
    def __init__(self, phi: RandomFeatures, weights: np.ndarray, steps: np.ndarray | None = None):
        self.phi, self.weights, self.steps = phi, weights, steps

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.phi(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a small part of the raw score keeps the order within a step."""
        raw = np.clip(self.raw(x), LOW, HIGH)
        centres = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
        return 0.99 * np.interp(raw, centres, self.steps) + 0.01 * (raw - LOW) / (HIGH - LOW)


def _features(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_STATISTICS)


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, x array<float>), then kept if docs have such a column."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(["kept"] if "kept" in docs.columns else []))
    kept = [rows.schema["kept"]] if "kept" in rows.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            x = np.array([statistics(t) for t in b.column(1).to_pylist()], np.float32).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * N_STATISTICS, x.ravel()), *b.columns[2:]], ["doc_id", "x", *b.schema.names[2:]])

    return rows.mapInArrow(run, StructType([StructField("doc_id", LongType()), StructField("x", ArrayType(FloatType())), *kept]))


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame) -> Model | None:
    """The model of labelled(x, y, fold); None if there are no rows. fold: 0 to FOLDS - 1; rows of a fold are calibrated by the model of the others."""
    moments = labelled.agg(F.count("*").alias("n"), *[f(F.col("x")[k]).alias(f"{name}{k}") for name, f in (("m", F.avg), ("s", F.stddev_pop)) for k in range(N_STATISTICS)]).first()
    if not moments["n"]:
        return None
    phi = RandomFeatures(*(np.array([moments[f"{name}{k}"] for k in range(N_STATISTICS)]) for name in "ms"))
    size = FEATURES + N_STATISTICS + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size + 1))
        for b in batches:
            x, y, fold = _features(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for k in range(FOLDS):
                if (fold == k).any():
                    z = phi(x[fold == k])
                    total[k] += z.T @ np.column_stack([z, y[fold == k]])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for part in b.column(0):
                total = np.frombuffer(part.as_py()) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = labelled.select("x", F.col("y").cast("double").alias("y"), "fold").mapInArrow(partial, "part binary").withColumn("lane", F.spark_partition_id())
    # by a column, so that Catalyst takes as few tasks as the matrices need
    parts = parts.repartition("lane").select("part").mapInArrow(added, "part binary")
    parts = parts.repartition(LAST).mapInArrow(added, "part binary").collect()  # LAST rows
    total = sum(np.frombuffer(r["part"]).reshape(FOLDS, size, size + 1) for r in parts)
    rows = lambda t: max(1.0, t[size - 1, size - 1])  # the constant's square, summed
    ridge = lambda t: np.linalg.solve(t[:, :size] + PENALTY * rows(t) * np.eye(size), t[:, size])
    model = Model(phi, ridge(total.sum(axis=0)))
    others = [Model(phi, ridge(total.sum(axis=0) - total[k])) for k in range(FOLDS)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, fold = _features(b.column(0)), b.column(2).to_numpy(zero_copy_only=False)
            raw = np.zeros(len(x))
            for k in range(FOLDS):
                if (fold == k).any():
                    raw[fold == k] = others[k].raw(x[fold == k])
            at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], ["bin", "y"])

    bins = labelled.select("x", F.col("y").cast("long").alias("y"), "fold").mapInArrow(binned, "bin int, y long").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    total, ones = np.zeros(BINS), np.zeros(BINS)
    for r in bins.collect():  # BINS rows at most
        total[r["bin"]], ones[r["bin"]] = r["n"], r["y"]
    model.steps = isotonic(total, ones)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; score is the calibrated chance of label 1.

    Learns from the labels of rows whose crc32 of the id as text isn't divisible by 5. Null and empty texts are scored from zero
    statistics, texts of any length from those of all their bytes. Null labels and ids teach nothing; repeated ids give a row each. Without labels every score is 0.5. Columns not named are
    ignored. No documents: no rows.
    """
    stats, model = _fitted(docs.select(id_col, text_col), labels, id_col, text_col, label_col)
    return _scored(stats, model, threshold)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns.

    Null, empty and very long texts are scored like any other; rows that are equal but for their ids stay or go together, repeated and null ids
    are kept apart as rows. Without labels all stay that 0.5 lets stay. No documents: no rows. Where ids are unique, only those of rejected rows meet the rows again; else the rows go through the scoring themselves.
    """
    if unique_ids(docs, id_col):
        scored = score_quality(docs, labels, id_col, text_col, label_col, threshold)
        rejected = written(scored.where("predicted = 0").select(F.col("doc_id").alias("rejected_")), "rejected")
        rows = docs.select(F.col(id_col).cast("long").alias("rejected_"), whole(docs).alias("kept"))
        return unwrapped(rows.join(with_broadcast_if(rejected, BROADCAST_ROWS), "rejected_", "left_anti"), "kept", docs.columns)
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), whole(docs).alias("kept"))
    _, model = _fitted(rows.drop("kept"), labels.select(F.col(id_col).alias("id_"), label_col), "id_", "text_", label_col)
    # the statistics are counted again rather than stored beside the texts
    stats = document_statistics(rows, "id_", "text_").withColumn("held_out", F.lit(False))
    return unwrapped(_scored(stats, model, threshold).where("predicted = 1"), "kept", docs.columns)


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, Model | None]:
    stats = written(document_statistics(docs, id_col, text_col), "statistics").withColumn("held_out", held_out(F.col("doc_id")))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y is not null and doc_id is not null")
    return stats, fit(written(stats.where(~F.col("held_out")).select("doc_id", "x").join(known, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled"))


def _scored(stats: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted), then kept if stats have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(_features(b.column(2))) if model else np.full(len(b), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.clip(score, 0, 1)), pa.array((score >= threshold).astype(np.int32)), *b.columns[3:]], ["doc_id", "held_out", "score", "predicted", *b.schema.names[3:]])

    kept = [stats.schema["kept"]] if "kept" in stats.columns else []
    made = [StructField("doc_id", LongType()), StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return stats.select("doc_id", "held_out", "x", *[f.name for f in kept]).mapInArrow(run, StructType([*made, *kept]))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
