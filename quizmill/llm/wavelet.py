"""Token ids in wavelet matrices, one compressed file a shard.

A shard holds whole documents in ascending id order. Its file has, for each bit of the ids from the highest, the plane of
these bits in the order that the planes above leave (zeros before ones, stable), with counts of ones up to
each block, so that access, rank (counting) and select (occurrence lookup) take a step a plane. Planes are compressed in pieces of PIECE bytes
that are read alone, so a step reads a piece and not its plane. Files are kept as rows of a
Parquet table (a row a shard), so that any file system Spark writes to will do and a lost task leaves no partial file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import table, written
from .tokens import default_path, encoder

MAGIC, BLOCK, PIECE = b"QMWM2\0", 512, 8192
#: Tokens after which a shard ends, at the end of a document.
SHARD_TOKENS = 1 << 19


class Plane:
    """A plane of a file. A piece is decompressed when it is first read."""

    def __init__(self, data: memoryview, ends: np.ndarray, size: int):
        self.data, self.ends, self.size, self.read = data, ends.tolist(), size, {}

    def __len__(self) -> int:
        return self.size

    def _piece(self, k: int) -> np.ndarray:
        if k not in self.read:
            self.read[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data[self.ends[k - 1] if k else 0 : self.ends[k]]), np.uint8)
        return self.read[k]

    def __getitem__(self, key: int | slice) -> np.ndarray:
        if isinstance(key, slice):
            a, b, _ = key.indices(self.size)
            parts = [self._piece(k)[max(a - k * PIECE, 0) : b - k * PIECE] for k in range(a // PIECE, -(-b // PIECE))]
            return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint8)
        return self._piece(key // PIECE)[key % PIECE]


class WaveletMatrix:
    """Rank and select over a sequence of ids below 2**bits."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray] | list[Plane], zeros: list[int], counts: list[np.ndarray] | None = None):
        self.n, self.bits, self.planes, self.zeros = n, bits, planes, zeros
        self.counts = counts or [self._count(p) for p in planes]

    @staticmethod
    def _count(plane: np.ndarray) -> np.ndarray:
        """Ones before each block."""
        padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8) + BLOCK // 8, np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, order = [], [], ids
        for k in range(bits - 1, -1, -1):
            bit = (order >> order.dtype.type(k)) & order.dtype.type(1)
            one = bit.view(np.uint8)[:: order.dtype.itemsize].astype(bool)
            planes.append(np.packbits(one))
            low = order.take(np.flatnonzero(~one))  # several times faster than by mask
            zeros.append(len(low))
            order = np.concatenate([low, order.take(np.flatnonzero(one))])
        return cls(len(ids), bits, planes, zeros)

    def decode(self, dtype: np.dtype) -> np.ndarray:
        """All ids: the planes' partitions are undone from the lowest bit up."""
        order = np.zeros(self.n, dtype)
        for k, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            one = np.unpackbits(plane[:], count=self.n).view(bool)
            above = np.empty(self.n, dtype)
            above[np.flatnonzero(~one)] = order[:zeros]
            above[np.flatnonzero(one)] = order[zeros:] | dtype.type(1 << k)
            order = above
        return order

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before position at."""
        block, plane = at // BLOCK, self.planes[level]
        found = int(self.counts[level][block])
        inside = plane[block * BLOCK // 8 : -(-at // 8)]
        if len(inside):
            found += int(np.unpackbits(inside)[: at - block * BLOCK].sum())
        return found

    def access(self, at: int) -> int:
        value = 0
        for level in range(self.bits):
            ones = self._ones(level, at)
            bit = int(self.planes[level][at // 8] >> (7 - at % 8)) & 1
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        start = 0
        for level in range(self.bits):
            a, b = self._ones(level, start), self._ones(level, end)
            if value >> (self.bits - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, value: int, end: int) -> int:
        """Occurrences of value before position end."""
        a, b = self._range(value, end)
        return b - a

    def select(self, value: int, nth: int) -> int:
        """Position of the nth occurrence, from 0; ValueError if there are fewer."""
        a, b = self._range(value, self.n)
        if not 0 <= nth < b - a:
            raise ValueError(f"{value} occurs {b - a} times")
        at = a + nth
        for level in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - level) & 1
            target = at - self.zeros[level] if one else at
            low, high = 0, self.n  # the least prefix with target + 1 such bits
            while low < high:
                mid = (low + high) // 2
                ones = self._ones(level, mid + 1)
                if (ones if one else mid + 1 - ones) > target:
                    high = mid
                else:
                    low = mid + 1
            at = low
        return at

    def occurrences(self, value: int) -> np.ndarray:
        """Positions of all occurrences in order: select of every one at once. Planes are read whole only if there are any."""
        at = np.arange(*self._range(value, self.n))
        for level in range(self.bits - 1, -1, -1):
            if len(at):
                one = value >> (self.bits - 1 - level) & 1
                at = np.flatnonzero(np.unpackbits(self.planes[level][:], count=self.n) == one)[at - self.zeros[level] if one else at]
        return at


def to_file(docs: np.ndarray, lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    """A shard's file: a header, the ends of its sections, then these, compressed: document ids, lengths, counts of each plane, pieces of each plane."""
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [docs.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), *(counts.astype("<u4").tobytes() for counts in matrix.counts)]
    for plane in matrix.planes:
        parts += [plane[at : at + PIECE].tobytes() for at in range(0, len(plane), PIECE)]
    parts = [pack(p) for p in parts]
    head = struct.pack(f"<QIBI{matrix.bits}Q", matrix.n, len(docs), matrix.bits, len(parts), *matrix.zeros)
    return MAGIC + head + np.cumsum([len(p) for p in parts]).astype("<u8").tobytes() + b"".join(parts)


def from_file(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids, lengths and the matrix. Pieces of planes are decompressed as they are needed."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a shard file")
    at = len(MAGIC)
    n, n_docs, bits, n_parts = struct.unpack_from("<QIBI", data, at)
    at += struct.calcsize("<QIBI")
    zeros = struct.unpack_from(f"<{bits}Q", data, at)
    at += 8 * bits
    ends = np.frombuffer(data, "<u8", n_parts, at).astype(np.int64)
    body = memoryview(data)[at + 8 * n_parts :]
    unpack = zstandard.ZstdDecompressor().decompress
    first = [unpack(body[a:b]) for a, b in zip([0, *ends.tolist()], ends[: 2 + bits].tolist(), strict=False)]
    size = -(-n // 8)
    pieces = -(-size // PIECE)
    start = lambda k: 2 + bits + k * pieces
    planes = [Plane(body[ends[start(k) - 1] :], ends[start(k) : start(k + 1)] - ends[start(k) - 1], size) for k in range(bits)]
    return np.frombuffer(first[0], "<i8"), np.frombuffer(first[1], "<u4"), WaveletMatrix(n, bits, planes, list(zeros), [np.frombuffer(c, "<u4") for c in first[2:]])


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, shards: int | None = None) -> DataFrame:
    """The written table (task, first, n_tokens, file): documents by ascending id over all tasks, in shards within a task.

    first: tokens of the task's earlier shards. Texts may be of any length: one is in one shard. Rows of equal id stand in the order of their texts' hashes, null ids come first
    and are -2**63 in the files. Null texts are empty. No rows: no shards.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, first = encoder(path), TaskContext.get().partitionId(), 0
        bits = max(1, (enc.slow.get_vocab_size() - 1).bit_length())
        ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held], np.int64)
            tokens = np.concatenate(held).astype(enc.dtype)
            data = to_file(np.array(ids, np.int64), lengths, WaveletMatrix.build(tokens, bits))
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([first], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([data], pa.binary())], ["task", "first", "n_tokens", "file"])

        for b in batches:
            column = b.column(0).to_pylist()
            for at in range(0, len(column), 64):
                part = enc.batch(b.column(1).slice(at, 64).to_pylist())
                ids += [-(1 << 63) if x is None else x for x in column[at : at + 64]]
                held += part
                size += sum(map(len, part))
                if size >= SHARD_TOKENS:
                    yield flush()
                    first, ids, held, size = first + size, [], [], 0
        if held:
            yield flush()

    spark = docs.sparkSession
    n = shards or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return written(rows.mapInArrow(run, "task int, first long, n_tokens long, file binary"), "wavelet")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' files alone."""
    dtype = np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                docs, lengths, matrix = from_file(b.column(2)[k].as_py())
                small = np.dtype("<u2") if matrix.bits <= 16 else dtype
                ids = matrix.decode(small).astype(dtype)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw, starts = memoryview(ids.tobytes()), ends - lengths
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, b.column(0)[k].as_py()), pa.int32()), pa.array(docs, mask=docs == -(1 << 63)), pa.array(starts + b.column(1)[k].as_py()), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())],
                    ["task", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    docs = shards.select("task", "first", "file").mapInArrow(run, "task int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # a row for each task that wrote shards
    tasks = shards.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    docs = docs.join(F.broadcast(tasks), "task")
    return docs.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def lookup(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, position): every occurrence of a token id, by rank and select on each shard's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                docs, lengths, matrix = from_file(data)
                starts = np.cumsum(lengths, dtype=np.int64) - lengths
                at = matrix.occurrences(token)
                doc = np.searchsorted(starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(docs[doc], mask=docs[doc] == -(1 << 63)), pa.array(at - starts[doc])], ["doc_id", "position"])

    return shards.select("file").mapInArrow(run, "doc_id long, position long")


def op4_wavelet_tokens(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(table(spark, sf_dir, "documents")))
