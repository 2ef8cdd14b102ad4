"""How sources of a language differ in their words: distances between all pairs, and each source's most over-represented terms.

Terms are cut from the UTF-8 bytes of a batch of texts at once, with a look-up table; slices with the same xxhash form a group if their bytes agree too.
Counts by source are summed by shuffles and stay distributed. Probabilities are whole numbers, so all sums are exact whatever their order. Rows of counts go to
tasks by language, block of terms and pair of tiles of sources, as a sparse matrix (CSR): each task has a bounded part of the vocabulary and of the sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import sliced, table, with_broadcast_if, written

#: A kept term is in so many documents of its language; counts are smoothed by SMOOTH; probabilities are in parts of a thousand to the power of DIGITS.
LEAST_DOCUMENTS, SMOOTH, DIGITS, TOP = 30, 5, 3, 50
#: Terms of a block and sources of a tile, on average.
TERMS, SOURCES = 2048, 128
#: So many kept terms, groups or languages may be broadcast (some tens of MB); more are joined by shuffle.
BROADCAST_ROWS = 500_000

LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def terms(texts: pa.Array, hashed=xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text of each term, its kind, the kinds' bytes): the maximal runs of letters in strings without nulls. Runs never cross texts."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    data = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[first:last]]
    offsets = offsets - first
    letter = LETTER[data]
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    start[cuts] |= letter[cuts]
    end[cuts - 1] |= letter[cuts - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    of = np.searchsorted(offsets, starts, side="right") - 1
    whole = data.tobytes()
    digests = np.array([hashed(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    _, shown, kind = np.unique(digests, return_index=True, return_inverse=True)
    kinds = [whole[a:b] for a, b in zip(starts[shown].tolist(), ends[shown].tolist(), strict=True)]
    for k in np.flatnonzero(_unlike(data, starts, ends, shown[kind])).tolist():  # same digest, other bytes
        own = whole[starts[k] : ends[k]]
        at = kinds.index(own, len(shown)) if own in kinds[len(shown) :] else len(kinds)
        kinds[at : at + 1] = [own]
        kind[k] = at
    return of, kind, kinds


def _unlike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, shown: np.ndarray) -> np.ndarray:
    """Which slices differ from the slice `shown` for them, byte by byte."""
    length = ends - starts
    unlike = length != length[shown]
    same = np.flatnonzero(~unlike)
    n = length[same]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    apart = data[np.repeat(starts[same], n) + within] != data[np.repeat(starts[shown[same]], n) + within]
    unlike[same] = np.logical_or.reduceat(apart, np.cumsum(n) - n)
    return unlike


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) as (lang, source, term, n, n_docs), summed within slices of batches."""
    for b in sliced(batches):
        of, kind, kinds = terms(b.column(2))
        if not len(kinds):
            continue
        groups: dict[tuple, int] = {}
        group = np.array([groups.setdefault(g, len(groups)) for g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
        cells, n = np.unique(group[of] * len(kinds) + kind, return_counts=True)
        per_text = np.unique(of * len(kinds) + kind)
        _, n_docs = np.unique(group[per_text // len(kinds)] * len(kinds) + per_text % len(kinds), return_counts=True)
        names = list(groups)
        lang, source = (pa.array([g[k] for g in names], pa.string()).take(pa.array(cells // len(kinds))) for k in (0, 1))
        term = pa.array(kinds, pa.binary()).take(pa.array(cells % len(kinds))).cast(pa.string())
        yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(n), pa.array(n_docs)], ["lang", "source", "term", "n", "n_docs"])


def share(n, total):
    """floor(1000^DIGITS * n / total) for whole 0 <= n <= total < 9e15, digit by digit to stay within 64 bits; numpy arrays or Python's numbers."""
    found = 0
    for _ in range(DIGITS):
        n = n * 1000
        found, n = found * 1000 + n // total, n % total
    return found


def share_column(n: Column, total: Column) -> Column:
    """The same, in the JVM."""
    found = F.lit(0).cast("long")
    for _ in range(DIGITS):
        n = n * F.lit(1000).cast("long")
        found, n = found * 1000 + F.call_function("div", n, total), n % total
    return found


def _apart(rows: pa.Table) -> pa.Table:
    """Distances between the sources of two tiles over one block of terms: rows(lang, block, a, b, tile, source, total, v, cells(col, n))."""
    one = rows.slice(0, 1).to_pylist()[0]
    names, code = np.unique(np.array(rows.column("source").to_pylist(), object), return_inverse=True)
    places = rows.column("cells").combine_chunks()
    lengths = pc.list_value_length(places).to_numpy(zero_copy_only=False)
    cells = places.flatten()
    row = np.repeat(code, lengths)
    order = np.argsort(row, kind="stable")
    row, col, n = row[order], cells.field("col").to_numpy()[order], cells.field("n").to_numpy()[order]
    first = np.searchsorted(row, np.arange(len(names) + 1))
    total, tile = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    total[code], tile[code] = rows.column("total").to_numpy(), rows.column("tile").to_numpy()
    v = one["v"]
    weight = np.maximum(1, total + SMOOTH * v)
    zero = 1 + share(np.full(len(names), SMOOTH), np.maximum(weight, SMOOTH))
    value = 1 + share(n + SMOOTH, weight[row])
    width = int(col.max()) + 1 if len(col) else 0
    mine, other = np.flatnonzero(tile == one["a"]), np.flatnonzero(tile == one["b"])
    sources, items, values = [], [], []
    kept = np.isin(row, other)
    row_b, col_b, value_b = row[kept], col[kept], value[kept]
    starts = np.searchsorted(row_b, other)
    some = np.searchsorted(row_b, other, side="right") > starts
    for a in mine:
        at = slice(first[a], first[a + 1])
        dense = np.full(width, zero[a])
        dense[col[at]] = value[at]
        base = np.abs(zero[a] - zero[other])
        # terms that a has, against b's value of an absent one; then those that b has, against its own
        sums = np.abs(value[at][:, None] - zero[other]).sum(axis=0) - (first[a + 1] - first[a]) * base + (v * base if one["block"] == 0 else 0)
        if len(row_b):
            facing = dense[col_b]
            sums[some] += np.add.reduceat(np.abs(facing - value_b) - np.abs(facing - zero[row_b]), starts[some])
        pairs = other > a if one["a"] == one["b"] else np.ones(len(other), bool)
        sources += [np.full(pairs.sum(), a), other[pairs]]
        items += [other[pairs], np.full(pairs.sum(), a)]
        values += [sums[pairs]] * 2
    sources, items, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sources, items, values))
    named = pa.array(names.tolist(), pa.string())
    return pa.table({"lang": pa.array([one["lang"]] * len(values), pa.string()), "source": named.take(pa.array(sources)), "item": named.take(pa.array(items)), "value": pa.array(values.astype(np.int64))})


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) of docs; null langs, sources and texts are ''.

    Terms are runs of letters (A-Z in lower case, and all beyond ASCII); a lang keeps those in at least `least_documents` of its rows. A term's probability in a group is
    1 + floor(10^9 (n + 5) / (N + 5 V)). part 'pair': each other source of the lang, by the sum over kept terms of the differences of both probabilities, all ranks.
    part 'term': the group's own kept terms of higher probability than in the whole lang, by the difference, to rank `top`. Larger values first, ties by item in byte order.
    Repeated rows count as often as they are there; a lang without kept terms has pairs of value 0; a single source has no pairs; no rows give none. Columns not named
    are ignored. Texts of any length are taken whole, in slices of a batch.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")).cast("string")
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    made = rows.mapInArrow(_counted, "lang string, source string, term string, n long, n_docs long")
    counts = written(made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= least_documents)
    vocabulary = written(vocabulary.drop("n_docs"), "terms")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    blocks = F.ceil(F.col("v") / TERMS)
    placed = vocabulary.join(with_broadcast_if(langs, BROADCAST_ROWS), "lang").withColumn("block", F.pmod(F.xxhash64("term"), blocks))
    placed = placed.withColumn("col", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1)
    kept = written(counts.drop("n_docs").join(with_broadcast_if(written(placed, "vocabulary"), BROADCAST_ROWS), ["lang", "term"]), "kept")

    groups = rows.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.first("v").alias("v")), ["lang", "source"], "left")
    groups = groups.join(with_broadcast_if(langs.select("lang", F.col("v").alias("v_lang")), BROADCAST_ROWS), "lang", "left")
    groups = written(groups.select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("v_lang", F.lit(0).cast("long")).alias("v")), "groups")
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("tiles"))
    groups = groups.join(with_broadcast_if(tiles, BROADCAST_ROWS), "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
    sized = kept.drop("v").join(with_broadcast_if(groups, BROADCAST_ROWS), ["lang", "source"])

    own = ["lang", "source", "total", "v", "tile", "tiles"]
    cells = sized.groupBy(*own, "block").agg(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), "n")).alias("cells"))  # of a block: bounded
    # every source meets every block, whether it has terms there or not
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") / TERMS)) - 1))
    there = groups.select(*own, every.alias("block"), F.array().cast(cells.schema["cells"].dataType).alias("cells"))
    met = cells.select(there.columns).unionByName(there).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    met = met.select("lang", "block", F.least("tile", "o").alias("a"), F.greatest("tile", "o").alias("b"), "tile", "source", "total", "v", "cells")
    apart = met.groupBy("lang", "block", "a", "b").applyInArrow(_apart, "lang string, source string, item string, value long")
    pairs = apart.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    chance = 1 + share_column(F.col("n") + SMOOTH, F.col("total") + SMOOTH * F.col("v"))
    usual = 1 + share_column(F.col("n_lang") + SMOOTH, F.col("total_lang") + SMOOTH * F.col("v"))
    over = sized.select("lang", "source", F.col("term").alias("item"), (chance - usual).alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda part, name: part.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(over, "term").where(F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT id, lang, source, unnest(w) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o JOIN v USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM v GROUP BY lang),
p AS MATERIALIZED (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
      CAST(1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + {SMOOTH})) // (coalesce(t.total, 0) + {SMOOTH} * l.v) AS BIGINT) AS p,
      CAST(1 + (1000000000 * (CAST(v.n AS HUGEINT) + {SMOOTH})) // (l.total + {SMOOTH} * l.v) AS BIGINT) AS q
      FROM g JOIN v ON v.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
QUALIFY part = 'pair' OR rank <= {TOP}
"""
