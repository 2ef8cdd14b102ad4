"""Similarities of vectors held as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-12))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine_to(vectors: DataFrame, column: str, target: list[float]) -> DataFrame:
    """vectors with `similarity` to one target, batches at a time in numpy: for many or long vectors."""
    goal = np.asarray(target, np.float64)
    size = float(np.sqrt(goal @ goal))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(b.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(goal))
            sim = (m @ goal) / (np.sqrt((m * m).sum(axis=1)) * size + 1e-12)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sim)], [*b.schema.names, "similarity"])

    ddl = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes)
    return vectors.mapInArrow(run, f"{ddl}, similarity double")
