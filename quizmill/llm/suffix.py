"""Removal of byte strings that start earlier in the corpus, with suffix arrays over shards of what can repeat.

1. Anchors: of each string of LENGTH bytes the 32-byte gram of least hash (the last of equal ones) is its anchor, so equal strings
   have equal anchors at the same place. Neighbouring strings share anchors: about one position in 35 is one.
2. Whole copies of an earlier text go at once. Of the rest only anchors that occur again can be in a repeat. They get their context: the bytes of all strings that chose them. Occurrences
   of one gram meet in a shard; of equal contexts all but the first are removed whole.
   Of equal contexts in a slice of a task's rows only the first is sent on, so a gram in very many documents isn't very many rows.
3. The different contexts of a gram go into a shard's text. Its suffix array is built by induced sorting, permuted common prefixes
   show which strings of LENGTH bytes are equal, and all but the first of these are removed.
A gram that occurs more than HOT times is dealt to several shards. Each removes what repeats within it, in the same way; the strings that are left of
such a gram, the first of their kind in their shards, then meet those of its other shards by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import released, sliced, small_enough, table, with_broadcast_if, written

LENGTH, GRAM = 100, 32
#: Bytes of a long text that are hashed at once; bytes of contexts that make a shard's text; occurrences of a gram that one shard takes, about.
CHUNK, SHARD, HOT = 1 << 19, 1 << 20, 20_000
#: So many row numbers, and digests or strings of LENGTH bytes, may be broadcast (some tens of MB).
BROADCAST_ROWS, BROADCAST_KEYS, END = 1_000_000, 200_000, 1 << 62
#: Suffixes a bucket, on average, from which vector operations by bucket pay.
WAVES = 128
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TAIL = np.uint64((1 << 20) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    with np.errstate(over="ignore"):
        h, power, width = data.astype(np.uint64) + np.uint64(1), _BASE, 1
        while width < GRAM:
            h = h[: len(h) - width] * power + h[width:]
            power, width = power * power, 2 * width
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x7FB5D329728EA185)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of anchors, and the first and last start of the strings that chose each."""
    found = []
    for at in range(0, max(0, len(text) - LENGTH + 1), CHUNK):
        data = np.frombuffer(text, np.uint8, min(CHUNK + LENGTH - 1, len(text) - at), at)
        h = gram_hashes(data)
        low = (h & ~_TAIL) | (_TAIL - np.arange(len(h), dtype=np.uint64))
        width, need = 1, LENGTH - GRAM + 1
        while 2 * width <= need:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if need > width:
            low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
        chosen = (_TAIL - (low & _TAIL)).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        last = np.append(first[1:], len(chosen)) - 1
        found.append((h[chosen[first]].view(np.int64), first + at, last + at))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _order(chars: np.ndarray) -> np.ndarray:
    """The stable order of chars below 2^32, by 16 bits at a time: numpy sorts these by their digits, in linear time."""
    order = np.argsort(chars.astype(np.uint16), kind="stable")
    high = chars >> 16
    return order[np.argsort(high[order].astype(np.uint16), kind="stable")] if high.any() else order


def _append(sa: np.ndarray, place: np.ndarray, chars: np.ndarray, items: np.ndarray, back: bool) -> None:
    """Items go to the next free places of their characters' buckets, in order (back: from the buckets' ends)."""
    if not len(items):
        return
    order = _order(chars)
    c, x = chars[order], items[order]
    fresh = np.flatnonzero(np.diff(c, prepend=-1))
    sizes = np.diff(np.append(fresh, len(c)))
    nth = np.arange(len(c)) - np.repeat(fresh, sizes)
    sa[place[c] - nth if back else place[c] + nth] = x
    place[c[fresh]] += -sizes if back else sizes


def _induce(t: np.ndarray, small: np.ndarray, heads: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Suffixes in the order that the sorted seeds (leftmost-smaller suffixes, the sentinel among them) induce.

    heads: where each bucket begins, and the end. Large buckets go in order; within one, suffixes whose predecessors fall into it again go in
    waves, each a vector operation. Many small buckets go suffix by suffix.
    """
    n, k = len(t), len(heads) - 1
    sa = np.full(n, -1, np.int32)
    _append(sa, heads[1:] - 1, t[seeds[::-1]], seeds[::-1], True)
    if n < WAVES * k:
        return _induce_singly(t, small, heads, sa)

    def before(held: np.ndarray, smaller: bool) -> np.ndarray:
        items = held[held > 0] - 1
        return items[small[items] == smaller]

    place = heads[:-1].copy()
    for c in range(k):  # larger-type suffixes
        at = heads[c]
        while at < place[c]:
            items, at = before(sa[at : place[c]], False), place[c]
            _append(sa, place, t[items], items, False)
        items = before(sa[at : heads[c + 1]], False)
        _append(sa, place, t[items], items, False)
    sa[1:][small[sa[1:]]] = -1
    place = heads[1:] - 1
    for c in range(k - 1, -1, -1):  # smaller-type suffixes, from the end
        at = heads[c + 1] - 1
        while at > place[c]:
            items, at = before(sa[place[c] + 1 : at + 1][::-1], True), place[c]
            _append(sa, place, t[items], items, True)
        items = before(sa[heads[c] : at + 1][::-1], True)
        _append(sa, place, t[items], items, True)
    return sa


def _induce_singly(t: np.ndarray, small: np.ndarray, heads: np.ndarray, seeded: np.ndarray) -> np.ndarray:
    lead = np.concatenate([[-1], t[:-1], [-1]])  # the character before each suffix; the last stands for free places
    larger = np.append(False, ~small)  # whether the suffix before is of the larger type
    larger[-1] = False
    sa, place, goes = seeded.tolist(), heads[:-1].tolist(), np.where(larger, lead, -1).tolist()
    for x in sa:  # grows as it goes
        c = goes[x]
        if c >= 0:
            sa[place[c]] = x - 1
            place[c] += 1
    place, goes = (heads[1:] - 1).tolist(), np.where(larger, -1, lead).tolist()
    for x in reversed(sa):  # as far as it has come
        c = goes[x]
        if c >= 0:
            sa[place[c]] = x - 1
            place[c] -= 1
    return np.array(sa, np.int32)


def _order_names(names: np.ndarray) -> np.ndarray:
    """The suffix order of a text of names, recursively. A name that occurs once ends every comparison that reaches it, so the names after it
    up to the next that is repeated are left out of the recursion; suffixes that begin with such names are in the names' order."""
    counts = np.bincount(names)
    again = counts[names] > 1
    kept = np.flatnonzero(again | np.append(False, again[:-1]))
    inner = kept[suffix_array(names[kept])]
    order = np.empty(len(names), np.int64)
    repeated = np.repeat(counts > 1, counts)
    order[repeated] = inner[again[inner]]
    single = np.flatnonzero(~again)
    order[~repeated] = single[_order(names[single])]
    return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of t, non-negative numbers, by induced sorting (a smallest sentinel is understood at the end).

    Leftmost-smaller substrings are sorted by inducing them from their characters, then named in order; if names repeat, the
    text of names, at most half as long, is sorted in the same way.
    """
    t = np.append(t, -1).astype(np.int32) + 1
    n = len(t)
    sizes = np.bincount(t)
    t = (np.cumsum(sizes > 0) - 1).astype(np.int32)[t]  # no empty buckets
    heads = np.concatenate([[0], np.cumsum(sizes[sizes > 0])])
    step = np.sign(np.diff(t))
    settled = np.where(step != 0, np.arange(n - 1), n)
    settled = np.minimum.accumulate(settled[::-1])[::-1] if n > 1 else settled
    small = np.ones(n, bool)  # smaller type; the last step is always down to the sentinel
    small[:-1] = step[settled] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) <= 1:
        return _induce(t, small, heads, lms if len(lms) else np.array([n - 1]))[1:]
    # leftmost-smaller substrings in order, then named: equal ones alike
    sa = _induce(t, small, heads, lms[_order(t[lms])])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    size_at = np.zeros(n, np.int64)
    size_at[lms[:-1]] = np.diff(lms)
    a, b = order[:-1], order[1:]
    same = size_at[a] == size_at[b]
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = t[a[live] + k] == t[b[live] + k]
        same[live[~equal]] = False
        live, k = live[equal], k + 1
        live = live[size_at[a[live]] >= k]
    names = np.zeros(n, np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    sorted_lms = lms[_order_names(names[lms])] if same.any() else order
    return _induce(t, small, heads, sorted_lms)[1:]


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted: for each position the length of the common prefix with the suffix before it in the array.

    Only where the characters before the two differ it is counted; elsewhere it is one less than a position earlier.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    counted = (before < 0) | (at == 0) | (before == 0) | (t[at - 1] != t[np.maximum(before, 1) - 1])
    plcp = np.zeros(n, np.int64)
    padded = np.concatenate([t, [-1, -2]])
    live = np.flatnonzero(counted & (before >= 0))
    k = 0
    while len(live):
        x, y = live + k, before[live] + k
        equal = (x < n) & (y < n)
        equal &= padded[np.minimum(x, n)] == padded[np.minimum(y, n + 1)]
        plcp[live[~equal]] = k
        live, k = live[equal], k + 1
    start = np.maximum.accumulate(np.where(counted, at, 0))
    return np.where(counted, plcp, plcp[start] - (at - start))


def repeated_strings(contexts: list[bytes], rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of every string of LENGTH bytes inside a context that equals one at a smaller (row, start)."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0  # between contexts
    context = np.repeat(np.arange(len(contexts)), sizes + 1)
    place = np.arange(len(text)) - (ends - sizes)[context]
    sa = suffix_array(text)
    linked = common_prefixes(text, sa)[sa] >= LENGTH
    whole = (sizes[context] - place >= LENGTH)[sa]
    group = np.cumsum(~linked)
    at, group = sa[whole], group[whole]
    row, start = rows[context[at]], starts[context[at]] + place[at]
    order = np.lexsort((start, row, group))
    group, row, start = group[order], row[order], start[order]
    # an overlap of contexts gives the same string twice
    again = np.diff(group, prepend=-1) == 0
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(group))))
    keep = again & ((row != row[first]) | (start != start[first]))
    return row[keep], start[keep]


def _later_copies(contexts: list[bytes], grams: np.ndarray, digests: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> list[int]:
    """Places of contexts that equal one at a smaller (row, start): what needn't be sent on, however common it is."""
    order = np.lexsort((starts, rows, digests, grams))
    fresh = (np.diff(grams[order], prepend=0) != 0) | (np.diff(digests[order], prepend=0) != 0)
    fresh[:1] = True
    head = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
    return [k for k, h in zip(order[~fresh].tolist(), head[~fresh].tolist(), strict=True) if contexts[k] == contexts[h]]


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans [a, b), as sorted spans apart from each other."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    fresh = np.append(True, a[1:] > reach[:-1])
    return a[fresh], reach[np.append(np.flatnonzero(fresh)[1:], len(a)) - 1]


class ShardFinder:
    """Reads contexts sorted by gram, salt, digest, row and start; yields (row, a, b, string): a span to remove, or (string not null) one to compare with other shards'."""

    def __init__(self):
        self.key = self.last = None
        self.pool: list[tuple[bytes, int, int]] = []  # for the next shard: grams with several contexts
        self.held: list[tuple[bytes, int, int]] = []  # different contexts of the present gram
        self.bytes, self.dealt = 0, False
        self.out: list[tuple[int, int, int, bytes | None]] = []

    def add(self, gram: int, salt: int, context: bytes, row: int, start: int, dealt: bool) -> None:
        if (gram, salt) != self.key:
            self.end_gram()
            self.key, self.last, self.dealt = (gram, salt), None, dealt
        if context == self.last:
            self.out.append((row, start, start + len(context), None))
            return
        self.last = context
        self.held.append((context, row, start))

    def end_gram(self) -> None:
        if self.dealt:
            gone = self._shard(self.held)
            for context, row, start in self.held:
                self.out += [(row, start + k, start + k + LENGTH, context[k : k + LENGTH]) for k in range(len(context) - LENGTH + 1) if (row, start + k) not in gone]
        elif len(self.held) > 1 or self.held and len(self.held[0][0]) > LENGTH:  # one context may repeat itself
            if len(self.held) > 1 or self._periodic(self.held[0][0]):
                self.pool += self.held
                self.bytes += sum(len(x[0]) for x in self.held)
        self.held, self.dealt = [], False
        if self.bytes >= SHARD:
            self.end_shard()

    @staticmethod
    def _periodic(context: bytes) -> bool:
        strings = {context[k : k + LENGTH] for k in range(len(context) - LENGTH + 1)}
        return len(strings) <= len(context) - LENGTH

    def _shard(self, items: list[tuple[bytes, int, int]]) -> set[tuple[int, int]]:
        """Spans of what repeats within the items, and the (row, start) of each such string."""
        if not items:
            return set()
        contexts, rows, starts = (list(c) for c in zip(*items, strict=True))
        row, start = repeated_strings(contexts, np.array(rows), np.array(starts))
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        for k in np.split(np.arange(len(row)), np.flatnonzero(np.diff(row)) + 1):
            if len(k):
                a, b = merged(start[k], start[k] + LENGTH)
                self.out += [(int(row[k[0]]), x, y, None) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return set(zip(row.tolist(), start.tolist(), strict=True)) if self.dealt else set()

    def end_shard(self) -> None:
        self._shard(self.pool)
        self.pool, self.bytes = [], 0

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * 4
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["row", "a", "b", "string"])


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text): row numbers grow with doc_id (null first). If ids are unique they are the numbers themselves."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").limit(1).count() == 0
    if plain:
        return rows.select(F.col("doc_id").alias("row"), "doc_id", "text")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return written(ordered.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")


def whole_copies(rows: DataFrame) -> DataFrame:
    """The written (row) of rows(row, text) whose whole text stands in an earlier row: nothing of theirs needs a search."""
    keyed = rows.select("row", F.md5(F.col("text").cast("binary")).alias("key"))
    # a table, not an aggregate under the join: so Catalyst can split a text that very many rows have
    least = written(keyed.groupBy("key").agg(F.min("row").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"), "firsts")
    return written(keyed.join(with_broadcast_if(least, BROADCAST_KEYS), "key").where("row <> least").select("row"), "copies")


def repeated_spans(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """(row, spans): spans array<struct<a, b>>, unmerged, of the bytes to remove from rows that aren't whole copies; rows without any are left out."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(1).cast(pa.large_binary())
            parts = [(row, *anchors(texts[k].as_py())) for k, row in enumerate(b.column(0).to_pylist())]
            ids = np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])
            h, first, last = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h), pa.array(first << 8 | (last - first))], ["row", "gram", "range"])

    long = rows.select("row", "text").where(F.octet_length("text") >= LENGTH)
    rest = long.join(with_broadcast_if(copies, BROADCAST_ROWS), "row", "left_anti")
    every = rest.mapInArrow(find, "row long, gram long, range long")  # hashed twice: cheaper than a table of all anchors
    # a table, not an aggregate under the join: so Catalyst can split a gram that is in very many documents
    counts = every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    again = written(counts.select("gram", F.ceil(F.col("n") / HOT).cast("int").alias("parts")), "grams")
    released(rows.sparkSession)
    ranges = every.join(again, "gram").groupBy("row").agg(F.collect_list(F.struct("gram", "range", "parts")).alias("held"))
    around = rows.select("row", "text").join(ranges, "row").select("row", "text", "held")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2048):
            texts = b.column(1).cast(pa.large_binary())
            counts = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            held = b.column(2).flatten()
            grams, ranges, parts = (held.field(k).to_numpy(zero_copy_only=False).copy() for k in (0, 1, 2))
            first, size = ranges >> 8, (ranges & 255) + LENGTH
            contexts, at = [], 0
            for k, n in enumerate(counts.tolist()):
                data = texts[k].as_py()
                contexts += [data[x : x + y] for x, y in zip(first[at : at + n].tolist(), size[at : at + n].tolist(), strict=True)]
                at += n
            digests = np.array([xxhash.xxh64_intdigest(c) for c in contexts], np.uint64).view(np.int64)
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), counts)
            salts = (((ids + first * 31).view(np.uint64) * _BASE >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int32)
            for k in _later_copies(contexts, grams, digests, ids, first):
                # its strings are in the batch's first such context: a span to remove, dealt by row, with its length for a digest
                grams[k], digests[k], contexts[k] = ids[k], size[k], None
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(digests), pa.array(ids), pa.array(first), pa.array(contexts, pa.binary()), pa.array(salts), pa.array(parts > 1)], ["gram", "digest", "row", "start", "context", "salt", "dealt"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = ShardFinder()
        for b in batches:
            for gram, salt, context, row, start, digest, dealt in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if context is None:
                    finder.out.append((row, start, start + digest, None))
                else:
                    finder.add(gram, salt, context, row, start, dealt)
            if len(finder.out) > 10_000:
                yield finder.drain()
        finder.end_gram()
        finder.end_shard()
        yield finder.drain()

    contexts = around.mapInArrow(cut, "gram long, digest long, row long, start long, context binary, salt int, dealt boolean")
    shards = contexts.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "digest", "context", "row", "start")
    spans = written(shards.select("gram", "salt", "context", "row", "start", "digest", "dealt").mapInArrow(search, "row long, a long, b long, string binary"), "spans")
    released(rows.sparkSession)
    strings = spans.where("string is not null")
    least = strings.groupBy("string").agg(F.min(F.struct("row", "a")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    least = written(least, "strings")  # a table, as above
    later = strings.join(with_broadcast_if(least, BROADCAST_KEYS), "string").where(F.struct("row", "a") != F.col("least"))
    both = spans.where("string is null").select("row", "a", "b").unionByName(later.select("row", "a", "b"))
    return written(both.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "rows-of-spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row, without the bytes covered by a string of LENGTH bytes that also starts earlier. Texts may be of any length.

    Earlier: at a smaller doc_id, or in the same row before. Null ids come first; rows of equal id go by a hash of their texts, equal rows in
    any order. Null texts are empty; texts under LENGTH bytes lose nothing. Columns not named are ignored. No rows: no rows.
    """
    rows = _numbered(docs, id_col, text_col)
    copies = whole_copies(rows.where(F.octet_length("text") >= LENGTH))
    held = with_broadcast_if(copies, BROADCAST_ROWS)
    spans, n = repeated_spans(rows, copies), F.octet_length("text").cast("long")
    released(docs.sparkSession)
    rest, hit = rows.join(held, "row", "left_anti"), spans.select("row")
    parts = []
    if small_enough(hit, BROADCAST_ROWS):  # other texts stay as they are, and needn't be shuffled
        zero = F.lit(0).cast("long")
        parts.append(rest.join(F.broadcast(hit), "row", "left_anti").select("doc_id", n.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept")))
        rest = rest.join(F.broadcast(hit), "row", "left_semi")
    out = rest.join(spans, "row", "left").select("doc_id", "text", "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts, lists, made = b.column(1).cast(pa.large_binary()), b.column(2), []
            for k, doc in enumerate(b.column(0).to_pylist()):
                data, spans = texts[k].as_py(), lists[k]
                if not spans.is_valid:
                    made.append((doc, len(data), 0, 0, data))
                    continue
                a, z = merged(*(np.minimum(spans.values.field(f).to_numpy(zero_copy_only=False), len(data)) for f in (0, 1)))
                edges = [0, *np.column_stack([a, z]).ravel().tolist(), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                made.append((doc, len(data), len(data) - len(kept), len(a), kept))
            columns = list(zip(*made, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.binary()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    parts.append(out.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))
    # copies go whole: nothing of their texts is read but the length
    parts.append(rows.join(held, "row", "left_semi").select("doc_id", n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept")))
    return reduce(DataFrame.unionByName, parts)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
