"""Best-two-fit packing of token sequences, planned on the histogram of lengths.

Only lengths matter to a packing, and there are at most `capacity` of them. So the plan is made of patterns (the lengths
in a bin) with a count of bins each; every pattern uses up some length, so patterns are about as few as lengths, however
many documents there are. Each piece then finds its own slot from its rank among the pieces of its length: no piece is moved to find a partner.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import sliced, table, with_broadcast_if, written
from .tokens import default_path, encoder


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), with as little unused room as the heuristic finds.

    A bin starts with the longest length left and is filled greedily with the longest that fits. Then, while
    room is left, its smallest document gives way to the two unpacked documents that fill the expanded gap best, if they
    fill more of it than that document did.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        left[length] += n
    plan = []
    sizes = np.arange(capacity + 1)
    longest = capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return plan
        left[longest] -= 1
        held, gap = [longest], capacity - longest
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            held.append(int(fits[-1]))
            left[fits[-1]] -= 1
            gap -= int(fits[-1])
        while gap and len(held) > 1:
            smallest = min(held[1:])
            room = gap + smallest
            below = np.maximum.accumulate(np.where(left[: room + 1] > 0, sizes[: room + 1], 0))  # the longest left, up to each size
            first = np.flatnonzero(left[: room + 1])
            first = first[first < room]
            if not len(first):
                break
            cap = np.minimum(first, room - first)
            second = below[cap]
            alone = (second == first) & (left[first] < 2)
            second = np.where(alone, below[np.maximum(cap - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            best = int(total.argmax())
            if total[best] <= smallest:
                break
            held.remove(smallest)
            left[smallest] += 1
            held += [int(first[best]), int(second[best])]
            left[first[best]] -= 1
            left[second[best]] -= 1
            gap = room - int(total[best])
        times = 1 + min(int(left[length]) // n for length, n in Counter(held).items())
        for length in held:
            left[length] -= times - 1
        plan.append((held, times))


def slots(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Columns length, first rank, first sequence, offset; sorted. A slot takes one piece of its length for each bin of its pattern."""
    rows, sequence, used = [], 0, Counter()
    for held, times in plan:
        offset = 0
        for length in held:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, task, nth): whole documents, those over capacity cut from the end.

    ids: little-endian, of 2 bytes if the vocabulary allows, else 4. nth counts the pieces of a length within the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for b in sliced(batches, 256):
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.batch(b.column(1).to_pylist()), strict=True):
                end = len(ids) - (len(ids) - 1) // capacity * capacity
                at = 0
                for piece, end in enumerate(range(end, len(ids) + 1, capacity)):
                    part = ids[at:end]
                    rows.append((doc, piece, at, end - at, part.astype(enc.dtype).tobytes(), zlib.crc32(part.astype("<u4").tobytes()), task, seen[end - at]))
                    seen[end - at] += 1
                    at = end
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], names)

    schema = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "nth"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, task int, nth long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset): every token of every row once. ids are left out unless with_ids.

    Null and empty texts are the end token alone, texts of any length are cut into as many pieces as they need. Repeated rows and ids, and null ids, are packed like any other row. Columns other
    than the two named are ignored. No rows: no rows. Sequences are gapless from offset 0, at most `capacity` long.
    """
    cut = written(pieces(docs, id_col, text_col, capacity, tokenizer or default_path()), "pieces")
    counts = written(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    # at most `capacity` rows
    plan = slots(best_two_fit({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(with_broadcast_if(written(counts, "before"), 200_000), ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    carried = ["doc_id", "piece", "start", "length", *(["ids"] if with_ids else []), "ids_crc32"]
    width = 1 << 44  # ranks are below this

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = plan[:, 0] * width + plan[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            slot = plan[np.searchsorted(keys, length * width + rank, side="right") - 1] if len(keys) else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(slot[:, 2] + rank - slot[:, 1]), pa.array(slot[:, 3])], [*carried, "sequence_id", "offset"])

    types = dict(ranked.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in carried) + ", sequence_id long, offset long"
    return ranked.select(*carried, "rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, ids concatenated in order."""
    part = F.struct("offset", "ids")
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=1024, with_ids=False)
