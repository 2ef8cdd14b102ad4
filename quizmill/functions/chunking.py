"""Chunks of texts: by sentences with a carried overlap, or of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .text import folded, let, sentences, strip, unnested

#: Texts that a worker folds at a time.
SLICE = 256


def fixed(text: Column, size: int, overlap: int) -> Column:
    """Windows of size characters that start every size - overlap; a last one inside the one before it is kept."""
    if not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must be from 0 to below size {size}")

    def cut(body: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(body) - 1, F.lit(size - overlap))
        many = F.transform(starts, lambda s: F.substring(body, s + 1, F.lit(size)))
        return F.when(body == "", F.array().cast("array<string>")).when(F.length(body) <= size, F.array(body)).otherwise(many)

    return let(strip(F.coalesce(text, F.lit(""))), cut)


def semantic(text: Column, size: int, fraction: float) -> Column:
    """Sentences joined up to size characters. The next chunk starts with as many of the last sentences as fit size * fraction.

    A sentence goes after the carried ones unchecked, so a chunk may be longer than size; no sentence is cut.
    """
    body = F.coalesce(text, F.lit(""))
    room = int(size * fraction)
    none, nothing = F.array().cast("array<string>"), F.lit(None).cast("string")
    start = F.struct(none.alias("cur"), F.lit(0).alias("n"))

    def carried(cur: Column) -> Column:
        zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(False).alias("full"))

        def take(a: Column, s: Column) -> Column:
            full = a["full"] | (a["n"] + F.length(s) + 1 > room)
            return F.struct((a["k"] + F.when(full, 0).otherwise(1)).alias("k"), F.when(full, a["n"]).otherwise(a["n"] + F.length(s) + 1).alias("n"), full.alias("full"))

        return F.aggregate(F.reverse(cur), zero, take)

    def add(a: Column, s: Column) -> Column:
        """The state with sentence s, and the chunk that is full before it, if one is; after the last sentence comes a null."""
        over = (a["n"] + F.length(s) + 1 > size) & (F.size(a["cur"]) > 0)

        def begun(keep: Column) -> Column:
            tail = F.slice(a["cur"], F.size(a["cur"]) - keep["k"] + 1, keep["k"])
            return F.struct(F.array_append(tail, s).alias("cur"), (keep["n"] + F.length(s) + 1).alias("n"))

        more = F.struct(F.array_append(a["cur"], s).alias("cur"), (a["n"] + F.length(s) + 1).alias("n"))
        state = F.when(s.isNull(), a).when(over, let(carried(a["cur"]), begun)).otherwise(more)
        return F.struct(state.alias("state"), F.when((s.isNull() & (F.size(a["cur"]) > 0)) | over, F.array_join(a["cur"], " ")).otherwise(nothing).alias("out"))

    def cut(parts: Column) -> Column:
        made = let(F.array_append(parts, nothing), lambda p: folded(p, start, add, "string"))
        return F.when(F.size(parts) == 0, F.array(body)).otherwise(F.filter(made, lambda x: x.isNotNull()))

    return F.when(strip(body) == "", none).otherwise(let(sentences(body), cut))


def semantic_lists(parts: list[str], size: int, fraction: float) -> list[str]:
    """The same of one text's sentences, linear in their number."""
    room, out, cur, n = int(size * fraction), [], [], 0
    for s in parts:
        if cur and n + len(s) + 1 > size:
            out.append(" ".join(cur))
            k = n = 0
            while k < len(cur) and n + len(cur[-k - 1]) + 1 <= room:
                n += len(cur[-k - 1]) + 1
                k += 1
            cur = cur[len(cur) - k :]
        cur.append(s)
        n += len(s) + 1
    return [*out, " ".join(cur)] if cur else out


def semantic_arrow(docs: DataFrame, text_col: str, size: int, fraction: float) -> DataFrame:
    """docs with chunks array<string>, for texts of book size: the fold over sentences runs in Python, SLICE texts at a time, so that what a worker holds besides Spark's batch doesn't grow with the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                b = batch.slice(at, SLICE)
                texts, parts = b.column(b.schema.get_field_index(text_col)), b.column(len(b.columns) - 1)
                made = [([] if whole is None or not whole.strip() else semantic_lists(p, size, fraction) or [whole]) for whole, p in ((t.as_py(), p.as_py()) for t, p in zip(texts, parts, strict=True))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.list_(pa.string()))], [*docs_columns, "chunks"])

    docs_columns = docs.columns
    ddl = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.withColumn("parts_", sentences(F.col(text_col))).mapInArrow(run, f"{ddl}, chunks array<string>")


def chunks(text: Column, config: Config = DEFAULT, mode: str | None = None) -> Column:
    """By the mode; fixed chunks overlap by a number of characters, whatever the fraction."""
    if (mode or config.chunk_mode) == "semantic":
        return semantic(text, config.chunk_size, config.chunk_overlap_fraction)
    return fixed(text, config.chunk_size, config.fixed_overlap_chars)


def exploded(docs: DataFrame, chunks_col: Column, *keep: str) -> DataFrame:
    """(kept columns, n_chunks, chunk_ix, text): long documents become many small rows before anything is shuffled."""
    rows = let(chunks_col, lambda c: F.transform(c, lambda x, i: F.struct(F.size(c).cast("long").alias("n_chunks"), i.alias("chunk_ix"), x.alias("text"))))
    return unnested(docs, rows, "chunk_ix", *keep)
