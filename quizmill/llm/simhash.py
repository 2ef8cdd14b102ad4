"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile.

Distinct fingerprints are dealt to cells by the population counts of their parts. The Hamming distance of two
fingerprints is at least the sum of the differences of their parts' population counts, so cell pairs whose counts
differ beyond the radius are skipped, and all others are compared by exclusive-or and bit counts in numpy, in large tiles again by sub-tiles of equal counts of the quarters.
A cell larger than TILE fingerprints is split by hash into several tiles; a task holds two tiles. Of the pairs within the
radius a task returns a least-distance spanning forest only (at most one link fewer than fingerprints), which has
the same components as all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .stage import released, sliced, table, unique_ids, unwrapped, whole, with_broadcast_if, written

#: Fingerprints of a tile at most, about. A task holds two tiles and CHUNK distances.
TILE, CHUNK = 32768, 2_000_000
#: Pairs of a tile pair from which sub-tiles pay.
SUBTILED = 1_000_000
#: Hashes of a text that are counted at once.
PART = 64 * 255
_LOW = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included. A-Z are lower-cased; words end at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: max(1, len(words) - size + 1)].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    del words
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """A bit of the fingerprint's first word is 1 if it is set in over half of the hashes; none: 0. Further words: of the hashes mixed anew."""
    counts = np.zeros((words, 8, 8), np.int64)  # by word, bit of a byte, byte
    for at in range(0, len(hashes), PART):
        some = hashes[at : at + PART]
        padded = np.zeros((words, -(-len(some) // 255) * 255), np.uint64)
        for k in range(words):
            padded[k, : len(some)] = some if k == 0 else _mixed(some, k)
        blocks = padded.reshape(words, -1, 255)
        for k in range(8):  # eight byte lanes at a time; 255 ones still fit a lane
            lanes = ((blocks >> np.uint64(k)) & _LOW).sum(axis=2, dtype=np.uint64)
            counts[:, k] += lanes.view(np.uint8).reshape(words, -1, 8).sum(axis=1, dtype=np.int64)
    places = (np.uint64(8) * np.arange(8, dtype=np.uint64))[None, :] + np.arange(8, dtype=np.uint64)[:, None]
    return ((counts * 2 > len(hashes)).astype(np.uint64) << places).sum(axis=(1, 2), dtype=np.uint64)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, fp array<long>): `words` times 64 bits. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            made = [majority(shingle_hashes(t, size), words).view(np.int64) for t in b.column(1).to_pylist()]
            flat = np.concatenate(made) if made else np.zeros(0, np.int64)
            offsets = np.arange(len(made) + 1, dtype=np.int32) * words
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp array<long>")


def spanning_forest(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Indexes of links that form a least-weight spanning forest of n nodes (Boruvka's rounds, vectorised)."""
    index = np.argsort(w, kind="stable")
    u, v, label, kept = u[index], v[index], np.arange(n), []
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return np.concatenate(kept) if kept else np.zeros(0, np.int64)
        u, v, index, a, b = u[apart], v[apart], index[apart], a[apart], b[apart]
        best = np.full(n, len(u))
        order = np.arange(len(u))
        np.minimum.at(best, a, order)
        np.minimum.at(best, b, order)
        chosen = np.unique(best[best < len(u)])
        kept.append(index[chosen])
        parent = np.arange(n)
        a, b = a[chosen], b[chosen]
        while True:
            low = np.minimum(parent[a], parent[b])
            if (parent[a] == low).all() and (parent[b] == low).all():
                break
            np.minimum.at(parent, parent[a], low)
            np.minimum.at(parent, parent[b], low)
            while (parent[parent] != parent).any():
                parent = parent[parent]
        label = parent[label]


def _quarters(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by the population counts of the first word's four quarters, the bounds of equal ones, and their counts."""
    counts = np.bitwise_count(np.ascontiguousarray(rows[:, 0]).view(np.uint16).reshape(-1, 4)).astype(np.int64)
    order = np.lexsort(counts.T)
    counts = counts[order]
    fresh = np.flatnonzero(np.append(True, (np.diff(counts, axis=0) != 0).any(axis=1)))
    return order, np.append(fresh, len(rows)), counts[fresh]


def _parts(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes into a and b of sub-tiles to compare. Those whose quarters' population counts differ beyond the radius are skipped, if that pays."""
    if radius > 8 or len(a) * len(b) < SUBTILED:
        step = max(1, CHUNK // max(1, len(b)))
        for at in range(0, len(a), step):
            yield np.arange(at, min(at + step, len(a))), np.arange(len(b))
        return
    (order_a, ends_a, counts_a), (order_b, ends_b, counts_b) = _quarters(a), _quarters(b)
    for k, counts in enumerate(counts_a):
        rows = order_a[ends_a[k] : ends_a[k + 1]]
        near = np.flatnonzero(np.abs(counts_b - counts).sum(axis=1) <= radius)
        if not len(near):
            continue
        others = np.concatenate([order_b[ends_b[x] : ends_b[x + 1]] for x in near])
        step = max(1, CHUNK // len(others))
        for at in range(0, len(rows), step):
            yield rows[at : at + step], others


def tile_links(a: np.ndarray, b: np.ndarray | None, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning links between the rows of a and b (b None: within a): their indexes in a followed by b, and distances.

    limits: the largest distance in the first word, in the first two, and so on to all words.
    """
    other = a if b is None else b
    base = 0 if b is None else len(a)
    n = len(a) + (0 if b is None else len(b))
    u = v = w = np.zeros(0, np.int64)
    for rows, others in _parts(a, other, limits[0]):
        part = other[others]
        d = np.bitwise_count(a[rows, :1] ^ part[:, 0][None, :])
        i, j = np.nonzero(d <= limits[0])
        total = d[i, j].astype(np.int64)
        i, j = rows[i], others[j]
        if b is None:
            later = j > i
            i, j, total = i[later], j[later], total[later]
        for k in range(1, other.shape[1]):
            total += np.bitwise_count(a[i, k] ^ other[j, k])
            near = total <= limits[k]
            i, j, total = i[near], j[near], total[near]
        if len(i):
            u, v, w = np.concatenate([u, i]), np.concatenate([v, j + base]), np.concatenate([w, total])
            if len(u) > n:
                keep = spanning_forest(n, u, v, w)
                u, v, w = u[keep], v[keep], w[keep]
    keep = spanning_forest(n, u, v, w)
    return u[keep], v[keep], w[keep]


def _matrix(column: pa.ListArray, words: int) -> list[np.ndarray]:
    """For each row of a list of fixed-size fingerprints, an array with a column a word."""
    inner = column.flatten().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)
    return np.split(inner, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def near_links(prints: DataFrame, limits: tuple[int, ...], cell: Column, dims: int, grain: int = 1) -> DataFrame:
    """(a, b, distance) between distinct fingerprints of prints(fp array<long>): a forest that spans each component.

    cell: array of `dims` population counts of disjoint parts of fp, divided by grain (rounded down).
    """
    words, spark = len(limits), prints.sparkSession
    cells = prints.select("fp", cell.alias("cell"))
    # few values, whatever the input: at most 33 squared, or the bits over the grain
    split = cells.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("split"))
    tiles = cells.join(F.broadcast(split), "cell").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("split")).cast("int"))
    tiles = written(tiles.groupBy("cell", "part").agg(F.collect_list("fp").alias("rows")), "tiles")
    meta = tiles.select("cell", "part")
    moves = F.broadcast(spark.createDataFrame([(m,) for m in _moves(dims, limits[-1], grain)], "move array<int>"))
    near = meta.join(moves, F.size("cell") == F.size("move")).select(F.col("cell").alias("cell_a"), F.col("part").alias("part_a"), F.zip_with("cell", "move", lambda x, y: x + y).alias("cell_b"))
    pairs = near.join(meta.select(F.col("cell").alias("cell_b"), F.col("part").alias("part_b")), "cell_b")
    pairs = pairs.where((F.col("cell_a") != F.col("cell_b")) | (F.col("part_a") <= F.col("part_b")))
    pairs = written(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    lanes = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def side(x: str) -> DataFrame:
        named = tiles.select(F.col("cell").alias(f"cell_{x}"), F.col("part").alias(f"part_{x}"), F.col("rows").alias(f"rows_{x}"))
        return named.join(pairs, [f"cell_{x}", f"part_{x}"]).select("pair", f"rows_{x}", (F.col("cell_a") == F.col("cell_b")).alias("level"), (F.col("part_a") == F.col("part_b")).alias("same")).repartition(lanes, "pair")

    work = side("a").join(side("b").drop("level", "same"), "pair").select((F.col("level") & F.col("same")).alias("same"), "rows_a", "rows_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, a, b in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), words), _matrix(batch.column(2), words), strict=True):
                u, v, w = tile_links(a, None if same else b, limits)
                both = a if same else np.concatenate([a, b])
                lists = [pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * words, both[x].view(np.int64).ravel()) for x in (u, v)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(w, pa.int32())], ["a", "b", "distance"])

    return work.mapInArrow(run, "a array<long>, b array<long>, distance int")


def _moves(dims: int, radius: int, grain: int = 1) -> list[list[int]]:
    """Differences of cells that can hold fingerprints within radius, one of each pair of opposites, zero included."""
    least = lambda x: max(0, abs(x) * grain - grain + 1)
    far = (radius + grain - 1) // grain
    found = [[]]
    for _ in range(dims):
        found = [[*m, x] for m in found for x in range(-far, far + 1) if sum(map(least, m)) + least(x) <= radius]
    return [m for m in found if m >= [0] * dims]


def _halves(word: str) -> Column:
    """Population counts of the two halves of a word."""
    return F.array(F.bit_count(F.expr(f"{word} & 4294967295L")).cast("int"), F.bit_count(F.expr(f"shiftrightunsigned({word}, 32)")).cast("int"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints link at radius or fewer bits, transitively.

    component_id is the smallest id in the component. Null, empty and blank texts share fingerprint 0 and are linked
    like any other; very long texts are hashed whole. Repeated ids give a row each; rows with a null id are kept, and their id is never a component_id
    unless a component has no other (then null). Columns other than the two named are ignored. No rows: no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, size), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = near_links(distinct, (radius,), _halves("fp[0]"), dims=2)
    roots = connected(links.select(F.col("a")[0].alias("a"), F.col("b")[0].alias("b")), "a", "b")
    nodes = distinct.select(F.col("fp")[0].alias("word"), "least").join(roots.withColumnRenamed("node", "word"), "word", "left")
    nodes = nodes.select("word", "least", F.coalesce("root", "word").alias("root"))
    # tables, not aggregates under the joins: so Catalyst can split a component or a fingerprint that many share
    nodes = written(nodes, "nodes")
    least = written(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = written(nodes.join(least, "root").select("word", "component_id"), "named")
    out = prints.select("doc_id", F.col("fp")[0].alias("word")).join(named, "word")
    return out.select("doc_id", F.lower(F.lpad(F.hex("word"), 16, "0")).alias("fingerprint"), "component_id")


#: For similarity 0.8 of shingle sets, sketches of 64, 128, 192 and 256 bits differ in 9.7, 19.4, 29.1 and 38.8 bits on average
#: (the angle whose cosine is 2s / (1 + s), over pi, of the bits); the limits are 3.5, 3.6, 3.3 and 3.2 standard deviations above.
SKETCH_LIMITS = (20, 34, 46, 57)
SIZE, SIMILARITY = 5, 0.8
#: What a block of documents weighs at most, about, when all their candidate pairs are tested: its shingles, and NODE a document.
BLOCK, NODE = 500_000, 256
#: Links of one row that a task tests, about; row numbers that may be broadcast (some tens of MB).
DEGREE, BROADCAST_ROWS = 256, 1_000_000


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """(row, shingles array<long>): the distinct shingle hashes of rows(row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in b.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, np.concatenate(sets) if sets else np.zeros(0, np.int64))], ["row", "shingles"])

    return rows.select("row", "text").mapInArrow(run, "row long, shingles array<long>")


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """(row, same binary, fp array<long>): a digest of the set of shingle hashes of rows(row, text), and the sketch of that set."""
    words = len(SKETCH_LIMITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            hashes = [np.unique(shingle_hashes(t, size)) for t in b.column(1).to_pylist()]
            same = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in hashes]
            made = [majority(h, words).view(np.int64) for h in hashes]
            offsets = np.arange(len(made) + 1, dtype=np.int32) * words
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.ListArray.from_arrays(offsets, np.concatenate(made) if made else np.zeros(0, np.int64))], ["row", "same", "fp"])

    return rows.select("row", "text").mapInArrow(run, "row long, same binary, fp array<long>")


def true_links(prints: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, first: int, similarity: float) -> list[tuple[int, int]]:
    """Indexes of linked rows. Pairs of the first rows with the others (of all, if there are no others) whose labels differ and whose
    sketches are within SKETCH_LIMITS are tested exactly, unless links found here join the two already."""
    others = np.arange(first, len(prints)) if first < len(prints) else np.arange(len(prints))
    label, sizes, out = np.unique(labels, return_inverse=True)[1], np.fromiter(map(len, sets), np.int64, len(sets)), []
    step = max(1, CHUNK // max(1, len(others)))
    for at in range(0, first, step):
        rows = np.arange(at, min(at + step, first))
        i, j = np.nonzero(label[rows][:, None] != label[others][None, :])
        i, j = rows[i], others[j]
        near = (i < j) & (np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]))
        i, j = i[near], j[near]
        total = np.zeros(len(i), np.int64)
        for k, limit in enumerate(SKETCH_LIMITS):
            total += np.bitwise_count(prints[i, k] ^ prints[j, k])
            near = total <= limit
            i, j, total = i[near], j[near], total[near]
        for x in np.argsort(total, kind="stable").tolist():
            u, v = int(i[x]), int(j[x])
            if label[u] == label[v]:
                continue
            shared = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
            if shared >= similarity * (sizes[u] + sizes[v] - shared):
                out.append((u, v))
                label[label == label[v]] = label[u]
    return out


def with_sets(links: DataFrame, sets: DataFrame, end: str, other: str, name: str) -> DataFrame:
    """links with the shingles of one end as a column. A row with many links is dealt to several tasks, and its set goes to each of them."""
    parts = links.groupBy(end).agg(F.ceil(F.count("*") / DEGREE).cast("int").alias("parts")).where("parts > 1")
    parts = with_broadcast_if(written(parts, "degrees"), BROADCAST_ROWS)
    deal = F.coalesce("parts", F.lit(1))
    dealt = links.join(parts, end, "left").withColumn("part", F.pmod(F.xxhash64(other), deal).cast("int")).drop("parts")
    each = sets.withColumnRenamed("row", end).join(parts, end, "left").select(end, F.explode(F.sequence(F.lit(0), deal - 1)).alias("part"), F.col("shingles").alias(name))
    return dealt.join(each, [end, "part"]).drop("part")


def links_within(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): labels that a true link joins, of nodes(comp, label, row, fp, shingles). All candidate pairs of a comp are tested whose labels differ.

    A comp is dealt to blocks by weight, and a group holds two blocks.
    """
    split = nodes.groupBy("comp").agg(F.ceil(F.sum(F.size("shingles") + NODE) / BLOCK).cast("int").alias("split"))
    dealt = nodes.join(with_broadcast_if(written(split, "splits"), BROADCAST_ROWS), "comp").withColumn("part", F.pmod(F.xxhash64("row"), F.col("split")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
    dealt = dealt.select("comp", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), (F.col("part") > F.col("other")).alias("second"), "label", "fp", "shingles")

    def run(group: pa.Table) -> pa.Table:
        second, labels = group["second"].to_numpy(), group["label"].to_numpy()
        order = np.argsort(second, kind="stable")
        prints = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group["fp"].chunks]).view(np.uint64).reshape(-1, len(SKETCH_LIMITS))[order]
        sets = [s for c in group["shingles"].chunks for s in np.split(c.flatten().to_numpy(zero_copy_only=False), np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))[:-1])]
        labels = labels[order]
        found = true_links(prints, [sets[k] for k in order], labels, int((~second).sum()), similarity)
        u, v = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(labels[u], pa.int64()), "b": pa.array(labels[v], pa.int64())})

    # else a partitioning by comp alone would do for Catalyst, and one task would get all groups of a comp
    dealt = dealt.repartition("comp", "part_a", "part_b")
    return dealt.groupBy("comp", "part_a", "part_b").applyInArrow(run, "a long, b long")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near-duplicates: of each group linked at `similarity` or more the row with the smallest id stays, with all its columns.

    256-bit sketches give a least-distance forest over the candidates; a link of it counts if the exact Jaccard similarity of the two
    shingle sets is at least `similarity`. Where links of the forest fail, all candidate pairs
    between the parts that they would have joined are tested. Equal shingle sets are one group, different ones of equal sketches are linked like any other. Blank and null
    texts are one group; very long texts are compared whole. Null ids come after others; rows of equal id in any order. No rows: no rows.
    """
    ids = F.col(id_col).cast("long")
    plain = unique_ids(docs, id_col)
    rows = docs.select((ids if plain else F.monotonically_increasing_id()).alias("row"), whole(docs).alias("kept"))
    if not plain:  # row numbers must stay the same
        rows = written(rows, "numbered")
    texts = rows.select("row", F.col(f"kept.{text_col}").alias("text"))
    prints = written(sketches(texts, size), "sketches")
    ids = rows.select("row", F.col(f"kept.{id_col}").cast("long").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "fp")
    distinct = written(prints.join(ids, "row").groupBy("same").agg(F.min(order).alias("least")).select("least.fp", "least.row", F.col("least").dropFields("fp").alias("least")), "distinct")
    stand = written(distinct.groupBy("fp").agg(F.min("row").alias("row")), "stand")
    counts = sum((F.bit_count(F.col("fp")[k]) for k in range(1, len(SKETCH_LIMITS))), F.bit_count(F.col("fp")[0]))
    links = near_links(stand, SKETCH_LIMITS, F.array(F.floor(counts / 8).cast("int")), dims=1, grain=8)
    links = links.join(stand.select(F.col("fp").alias("a"), F.col("row").alias("row_a")), "a").join(stand.select(F.col("fp").alias("b"), F.col("row").alias("row_b")), "b")
    alike = distinct.join(stand.withColumnRenamed("row", "row_a"), "fp").where("row <> row_a").select("row_a", F.col("row").alias("row_b"))
    links = written(links.select("row_a", "row_b").unionByName(alike).distinct(), "candidates")
    held = written(links.select(F.explode(F.array("row_a", "row_b")).alias("row")).distinct(), "held")
    released(docs.sparkSession)
    sets = written(shingle_sets(texts.join(with_broadcast_if(held, BROADCAST_ROWS), "row", "left_semi"), size), "shingles")
    both = with_sets(with_sets(links, sets, "row_a", "row_b", "x"), sets, "row_b", "row_a", "y")
    shared = F.size(F.array_intersect("x", "y"))
    tested = written(both.select("row_a", "row_b", (shared >= similarity * (F.size("x") + F.size("y") - shared)).alias("linked")), "tested")
    roots = connected(tested.where("linked"), "row_a", "row_b").withColumnRenamed("node", "row")
    nodes = written(distinct.join(roots, "row", "left").withColumn("label", F.coalesce("root", "row")), "nodes")
    label = lambda x: nodes.select(F.col("row").alias(f"row_{x}"), F.col("label").alias(f"label_{x}"))
    # parts that failed links would have joined: a true link between two of them may not be in the forest
    failed = tested.where("not linked").join(label("a"), "row_a").join(label("b"), "row_b")
    comps = connected(failed, "label_a", "label_b").select(F.col("node").alias("label"), F.col("root").alias("comp"))
    doubtful = nodes.join(with_broadcast_if(written(comps, "comps"), BROADCAST_ROWS), "label").join(sets, "row")
    more = connected(links_within(written(doubtful.select("comp", "label", "row", "fp", "shingles"), "doubtful"), similarity), "a", "b")
    groups = nodes.join(more.select(F.col("node").alias("label"), F.col("root").alias("top")), "label", "left")
    stay = groups.groupBy(F.coalesce("top", "label").alias("group")).agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))
    # ids of the rows that go, not of those that stay: mostly few enough to spare the texts a shuffle
    gone = written(prints.select("row").join(stay, "row", "left_anti"), "gone")
    released(docs.sparkSession)
    return unwrapped(rows.join(with_broadcast_if(gone, BROADCAST_ROWS), "row", "left_anti"), "kept", docs.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=3)
