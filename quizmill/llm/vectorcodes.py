"""Codes of vectors: each of four parts is replaced by the index of its nearest codebook entry, all in whole numbers.

A float32 matrix product gives the squared distances of a block of vectors to all entries, less each vector's own square, with an error that a bound on the
rounding of any order of summation covers. Entries whose interval overlaps that of the best are measured again in int64; ties go to the lower index.
Codebooks are of fixed size (256 entries) and go to the tasks in their closures; each round is one pass over the vectors, whose tasks hand on at most one row
of sums for each part and entry. No vectors are collected but the first 256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .stage import table, with_broadcast_if, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of a block, and int64 components that are measured again at a time: 8 MB each.
ROWS, AGAIN = 4096, 1 << 20
#: So many labels may be broadcast (some tens of MB); more are joined by shuffle.
BROADCAST_ROWS = 500_000
UNIT = 2.0**-24  # half of float32's spacing at 1


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole_numbers(column: pa.Array, size: int) -> np.ndarray:
    """floor(SCALE * x) of lists of `size` numbers, a row each. The product is exact in float64, as SCALE is a power of two."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * SCALE).astype(np.int64).reshape(-1, size)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of entries for each row of x; int64 in, exact, ties to the lower index.

    With u = 2^-24 a float32 sum of w products is off by at most g * |x| * |c|, g = (w + 2) u / (1 - (w + 2) u), in whatever order it is added up and with both sides
    rounded to float32 before. The float64 steps around it are covered by a factor and by a term of their own.
    """
    width = x.shape[1]
    g = (width + 2) * UNIT / (1 - (width + 2) * UNIT) * (1 + 1e-6)
    squares = (entries * entries).sum(axis=1)
    length = np.sqrt(squares.astype(np.float64))
    transposed = np.ascontiguousarray(entries.T.astype(np.float32))
    at, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for low in range(0, len(x), ROWS):
        block = x[low : low + ROWS]
        own = np.sqrt((block * block).sum(axis=1).astype(np.float64))
        screened = squares - 2.0 * (block.astype(np.float32) @ transposed).astype(np.float64)
        off = 2 * g * own[:, None] * length + 1e-12 * (squares + 2 * own[:, None] * length)
        row, entry = np.nonzero(screened - off <= (screened + off).min(axis=1)[:, None])
        exact = np.empty(len(row), np.int64)
        for k in range(0, len(row), step := max(1, AGAIN // max(1, width))):
            apart = block[row[k : k + step]] - entries[entry[k : k + step]]
            exact[k : k + step] = (apart * apart).sum(axis=1)
        first = np.searchsorted(row, np.arange(len(block)))  # each row has an entry at least, in order of index
        best = np.minimum.reduceat(exact, first)
        chosen = np.flatnonzero(exact == best[row])
        chosen = chosen[np.searchsorted(row[chosen], np.arange(len(block)))]
        at[low : low + ROWS], distance[low : low + ROWS] = entry[chosen], best
    return at, distance


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def _moved(vectors: DataFrame, size: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: each used entry becomes the floor of its parts' mean."""
    width = size // PARTS
    sums = [f"s{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), width + 1), np.int64) for b in books]
        for batch in batches:
            for t, book, part in zip(total, books, _parts(whole_numbers(batch.column(0), size)), strict=True):
                at, _ = nearest(part, book)
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                if len(used):
                    t[used] += np.add.reduceat(np.column_stack([part, np.ones(len(part), np.int64)])[order], first)
        for k, t in enumerate(total):
            used = np.flatnonzero(t[:, -1])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), *[pa.array(c) for c in t[used].T]], ["part", "entry", *sums, "n"])

    made = vectors.select("vector").mapInArrow(run, "part int, entry int, " + ", ".join(f"{c} long" for c in [*sums, "n"]))
    moved = [b.copy() for b in books]
    # PARTS * ENTRIES rows at most
    for r in made.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in [*sums, "n"]]).collect():
        moved[r["part"]][r["entry"]] = np.array([r[c] // r["n"] for c in sums], np.int64)
    return moved


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row whose vector has only finite components; the others go.

    code: two hex digits a part, the index of its entry. error: squared distance to the entries, in units of 1/SCALE. label_error: its sum over rows of the same label, nulls
    together. The codebooks start as the parts of the first 256 vectors by id (null ids last, equal ids by their vectors; fewer vectors give fewer entries)
    and move for 4 rounds, to the floor of the mean of what is assigned; entries without any stay. Repeated rows count as often as they are there. Vectors must have one length: the most
    frequent among those that 4 divides (the shorter of two as frequent); rows of other lengths stay, with null code and error, outside the fit. No usable rows: no rows; columns not named are ignored.
    Components so large that sums could pass 64 bits raise a ValueError.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")).where(usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))).alias("most"))
    found = lengths.where((F.col("size") % PARTS == 0) & (F.col("size") > 0)).orderBy(F.desc("n"), "size").first()
    books, size = [], 0
    if found is not None:
        size, most = found["size"], int(min(found["most"], 2.0**42) * SCALE) + 1
        if max(4 * size * most**2, found["n"] * most) >= 1 << 63:
            raise ValueError(f"components of up to {found['most']} are too large for sums in 64 bits")
        rows = rows.withColumn("fits", F.size("vector") == size)
        fitting = rows.where("fits")
        first = fitting.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()  # 256 rows
        start = np.floor(np.array([r["vector"] for r in first], np.float64) * SCALE).astype(np.int64)
        books = [np.ascontiguousarray(p) for p in _parts(start)]
        for _ in range(ROUNDS):
            books = _moved(fitting, size, books)
    else:
        rows = rows.withColumn("fits", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            codes, errors = np.full(len(fits), None, object), np.zeros(len(fits), np.int64)
            if fits.any():
                both = [nearest(p, b) for p, b in zip(_parts(whole_numbers(batch.column(1).filter(batch.column(3)), size)), books, strict=True)]
                digits = np.column_stack([at.astype(np.uint8) for at, _ in both]).tobytes().hex()
                codes[fits] = [digits[k : k + 2 * PARTS] for k in range(0, len(digits), 2 * PARTS)]
                errors[fits] = sum(d for _, d in both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.string()), pa.array(errors, mask=~fits)], ["vec_id", "label", "code", "error"])

    label = StructField("label", rows.schema["label"].dataType)
    schema = StructType([StructField("vec_id", LongType()), label, StructField("code", StringType()), StructField("error", LongType())])
    coded = written(rows.select("vec_id", "vector", "label", "fits").mapInArrow(run, schema), "codes")
    # sums of a label are made before anything is shuffled, so that a frequent one costs no more than others
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(with_broadcast_if(sums, BROADCAST_ROWS), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return encode_vectors(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds one after the other, every distance in whole numbers."""
    take = ", ".join(f"v[1 + {p} * len(v) // {PARTS} : {p + 1} * len(v) // {PARTS}]" for p in range(PARTS))
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, unnest(range({PARTS})) AS p, unnest([{take}]) AS x FROM kept)",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM kept QUALIFY j < {ENTRIES})",
        "books0 AS MATERIALIZED (SELECT p, j, x AS c FROM parts JOIN first USING (vec_id))",
    ]
    apart = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(ROUNDS + 1):
        steps.append(f"near{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min({{'d': CAST({apart} AS BIGINT), 'j': j}}) AS m FROM parts JOIN books{r} USING (p) GROUP BY vec_id, p)")
        if r < ROUNDS:
            steps.append(f"sums{r} AS (SELECT p, j, i, CAST(floor_div(sum(y), count(*)) AS BIGINT) AS c FROM (SELECT p, m.j AS j, unnest(x) AS y, unnest(range(len(x))) AS i FROM near{r}) GROUP BY p, j, i)".replace("floor_div(sum(y), count(*))", "(sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*)"))
            steps.append(f"means{r} AS (SELECT p, j, list(c ORDER BY i) AS c FROM sums{r} GROUP BY p, j)")
            steps.append(f"books{r + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.c, b.c) AS c FROM books{r} b LEFT JOIN means{r} m ON m.p = b.p AND m.j = b.j)")
    steps += [
        f"coded AS (SELECT vec_id, string_agg(printf('%02x', m.j), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM books{ROUNDS})",
    ]
    return f"WITH {', '.join(steps)} SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept k JOIN coded USING (vec_id), digest"


OP11_SQL = _sql()
