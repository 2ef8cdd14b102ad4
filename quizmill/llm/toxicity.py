"""Toxicity: class-conditional Kneser-Ney models of how words are spelled, compared over a text.

A word is a run of letters in lower case between marks; a model gives each of its letters a chance after the up to DEPTH - 1 characters before it. For each
class c of labelled documents, with discount D and strength S,

    P_c(x | h) = (max(n_c(hx) - D, 0) + (S + D k_c(h)) P(x | h)) / (n_c(h) + S)

where k_c(h) counts the letters seen after h. P is the backoff that both classes share: the same with the counts of both (and no strength), which backs off to Kneser-Ney's
continuation counts of ever shorter contexts. So where neither class has seen hx, the ratio of both chances needs only the contexts' counts, and where none has seen h it is 1.
Expressions that were never seen as a whole are judged by their stems.

A toxic text is mostly made of ordinary words: of its words a share MIXED is taken from the toxic model, the others from the ordinary one. A text's score is the
log-likelihood ratio of both hypotheses over its number of words to the power of LENGTH, calibrated isotonically on texts that the model of the other fold scored.

Counts are of documents that hold a word, so repeats within a text don't add up. All labelled documents count; the counts are Spark tables that grow with them.
Log ratios by gram go to the tasks as sorted arrays while their number is below MODEL_ROWS; beyond it words meet them by shuffles.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .quality import isotonic
from .stage import sliced, small_enough, table, with_broadcast_if, written

DEPTH, DISCOUNT, STRENGTH, MIXED, LENGTH, ALPHABET = 7, 0.75, 20.0, 0.003, 0.8, 1000
#: Folds of the calibration, its bins, and the range of asinh(ratio / UNIT) that they divide.
FOLDS, BINS, UNIT, LOW, HIGH = 2, 1000, 0.001, -8.0, 12.0
#: So many grams go to every task (20 bytes each); so many labels may be broadcast.
MODEL_ROWS, BROADCAST_ROWS = 4_000_000, 1_000_000
#: Words whose ratios a worker keeps at a time, and words of a text that are looked up at a time.
CACHED, PIECE = 200_000, 10_000
START, END, OPEN = "\x01", "\x02", "\x03"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
RATIOS = ["ratio", *[f"ratio{k}" for k in range(FOLDS)]]


def words(text: str | None) -> Counter[str]:
    return Counter(WORD.findall((text or "").lower()))


def grams(word: str) -> list[str]:
    """For each letter and the end of a word: it and up to DEPTH - 1 characters before it."""
    marked = START + word + END
    return [marked[max(0, k - DEPTH + 1) : k + 1] for k in range(1, len(marked))]


def training_words(known: DataFrame) -> DataFrame:
    """known(text, y, fold): (word, n00, n01, n10, n11), the documents of class c and fold f that hold the word in n{c}{f}."""
    cells = [f"n{c}{f}" for c in (0, 1) for f in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [Counter() for _ in cells]
            for text, y, fold in zip(*[c.to_pylist() for c in b.columns], strict=True):
                found[y * FOLDS + fold].update(words(text).keys())
            kinds = list(set().union(*found))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), *[pa.array([c[w] for w in kinds], pa.int64()) for c in found]], ["word", *cells])

    made = known.select("text", F.col("y").cast("int"), F.col("fold").cast("int")).mapInArrow(run, "word string, " + ", ".join(f"{c} long" for c in cells))
    return made.groupBy("word").agg(*[F.sum(c).alias(c) for c in cells])


def word_grams(kinds: DataFrame, *keep: str) -> DataFrame:
    """A row (g, *keep) for each gram of each word."""
    marked = F.concat(F.lit(START), "word", F.lit(END))
    ends = F.sequence(F.lit(2), F.length("word") + 2)
    cut = F.transform(ends, lambda k: F.substring(marked, F.greatest(F.lit(1), k - DEPTH + 1), F.least(k, F.lit(DEPTH))))
    return kinds.select(F.explode(cut).alias("g"), *keep)


def _context(g: str = "g") -> Column:
    return F.expr(f"substring({g}, 1, length({g}) - 1)")


def backed_off(seen: DataFrame) -> DataFrame:
    """(g, low) for every proper suffix of the grams of seen: the Kneser-Ney chance of its last letter after the others, by continuation counts."""
    parts = seen.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("g")), lambda k: F.substring("g", k, F.length("g")))).alias("g")).distinct()
    parts = written(parts, "parts")
    counts = parts.where(F.length("g") > 1).groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("n"))
    contexts = counts.groupBy(_context().alias("h")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    counts = counts.withColumn("h", _context()).join(contexts, "h")
    terms = written(counts.select("g", (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")).alias("a"), (DISCOUNT * F.col("kinds") / F.col("total")).alias("b")), "continuations")
    level = terms.where(F.length("g") == 1).select("g", (F.col("a") + F.col("b") / ALPHABET).alias("low"))
    levels = [level]
    for k in range(2, DEPTH):
        mine = terms.where(F.length("g") == k).withColumn("shorter", F.expr("substring(g, 2)"))
        level = written(mine.join(level.select(F.col("g").alias("shorter"), "low"), "shorter").select("g", (F.col("a") + F.col("b") * F.col("low")).alias("low")), f"lower{k}")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def log_ratios(kinds: DataFrame) -> DataFrame:
    """(g, ratio, ratio0, ratio1): log P_1 - log P_0 for every gram seen, and for every context the ratio of letters never seen after it, as context + OPEN.

    ratio is of all documents' counts, ratio{f} of those outside fold f.
    """
    cells = [f"n{c}{f}" for c in (0, 1) for f in range(FOLDS)]
    seen = written(word_grams(kinds, *cells).groupBy("g").agg(*[F.sum(c).alias(c) for c in cells]), "grams")

    def count(c: int, without: int | None) -> Column:
        return reduce(Column.__add__, [F.col(f"n{c}{f}") for f in range(FOLDS) if f != without])

    models = [None, *range(FOLDS)]
    named = {(c, f): f"{c}{'' if f is None else f}" for c in (0, 1) for f in models}
    each = seen.select("g", _context().alias("h"), *[count(c, f).alias(f"n{k}") for (c, f), k in named.items()], (count(0, None) + count(1, None)).alias("n"))
    totals = [a for k in named.values() for a in (F.sum(f"n{k}").alias(f"s{k}"), F.sum((F.col(f"n{k}") > 0).cast("long")).alias(f"k{k}"))]
    contexts = written(each.groupBy("h").agg(*totals, F.sum("n").alias("s"), F.count("*").alias("k")), "contexts")

    def open_share(k: str) -> Column:
        return (STRENGTH + DISCOUNT * F.col(f"k{k}")) / (F.col(f"s{k}") + STRENGTH)

    def ratio(p: Callable[[str], Column], f: int | None) -> Column:
        return (F.log(p(named[1, f])) - F.log(p(named[0, f]))).alias(RATIOS[0 if f is None else f + 1])

    lower = backed_off(seen.select("g"))
    rows = each.join(contexts, "h").withColumn("shorter", F.expr("substring(g, 2)"))
    rows = rows.join(lower.select(F.col("g").alias("shorter"), "low"), "shorter")
    both = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("k") * F.col("low")) / F.col("s")
    rows = rows.withColumn("both", both)
    chance = lambda k: F.greatest(F.col(f"n{k}") - DISCOUNT, F.lit(0.0)) / (F.col(f"s{k}") + STRENGTH) + open_share(k) * F.col("both")
    return rows.select("g", *[ratio(chance, f) for f in models]).unionByName(contexts.select(F.concat("h", F.lit(OPEN)).alias("g"), *[ratio(open_share, f) for f in models]))


def mixed(ratio: np.ndarray) -> np.ndarray:
    """Of a word's log ratio, what it adds to that of a text with a share MIXED of toxic words."""
    return np.logaddexp(math.log1p(-MIXED), math.log(MIXED) + ratio)


class Ratios:
    """What words add to a text's log ratios under each model, from sorted hashes of grams."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.place: dict[str, int] = {}
        self.added = np.zeros((CACHED, len(RATIOS)))

    def find(self, asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in asked], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at

    def of(self, asked: list[str]) -> np.ndarray:
        """A row for each word, whether it was met before or not."""
        cut = [grams(w) for w in asked]
        flat = [g for c in cut for g in c]
        hit, at = self.find(flat)
        missed = np.flatnonzero(~hit)
        value = np.zeros((len(flat), len(RATIOS)))
        value[hit] = self.values[at[hit]]
        if len(missed):
            hit, at = self.find([flat[k][:-1] + OPEN for k in missed])
            value[missed[hit]] = self.values[at[hit]]
        return mixed(np.add.reduceat(value, np.cumsum([0, *map(len, cut[:-1])]), axis=0))

    def score(self, found: Counter[str]) -> np.ndarray:
        """The text's ratios, each over the number of words to the power of LENGTH; zeros without words."""
        kinds, total = list(found), np.zeros(len(RATIOS))
        for low in range(0, len(kinds), PIECE):
            some = kinds[low : low + PIECE]
            new = [w for w in some if w not in self.place]
            if len(self.place) + len(new) > CACHED:
                self.place.clear()
                new = some
            if new:
                first = len(self.place)
                self.added[first : first + len(new)] = self.of(new)
                self.place.update(zip(new, range(first, first + len(new)), strict=True))
            total += np.array([found[w] for w in some]) @ self.added[[self.place[w] for w in some]]
        return total / max(1, found.total()) ** LENGTH


def _by_arrays(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """(doc_id, *RATIOS) with the log ratios in every task: MODEL_ROWS at most."""
    model = ratios.select(F.xxhash64("g").alias("key"), *[F.col(c).cast("float") for c in RATIOS]).toArrow()
    keys = model["key"].to_numpy()
    order = np.argsort(keys)
    shared = rows.sparkSession.sparkContext.broadcast((keys[order], np.column_stack([model[c].to_numpy()[order] for c in RATIOS])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Ratios(*shared.value)
        for b in sliced(batches):
            values = np.array([found.score(words(t)) for t in b.column(1).to_pylist()]).reshape(-1, len(RATIOS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in values.T]], ["doc_id", *RATIOS])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in RATIOS))


def _by_joins(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """The same by shuffles: words of texts, each kind of word once, and its grams. Equal rows are worked on once, and come back as often as they are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            ids, digests, kinds, n = [], [], [], []
            for i, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                found = words(t)
                digest = xxhash.xxh3_128_digest((t or "").encode())
                ids += [i] * (len(found) + 1)
                digests += [digest] * (len(found) + 1)
                kinds += ["", *found]  # one row for the text itself
                n += [1, *found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(kinds, pa.string()), pa.array(n, pa.int64())], ["doc_id", "digest", "word", "n"])

    held = written(rows.mapInArrow(run, "doc_id long, digest binary, word string, n long"), "held")
    asked = written(held.where("word <> ''").select("word").distinct(), "kinds")
    cut = word_grams(asked, "word").groupBy("word", "g").agg(F.count("*").alias("times"))
    hit = cut.join(ratios.withColumn("hit", F.lit(True)), "g", "left")
    missed = hit.where("hit is null").select("word", F.concat(_context(), F.lit(OPEN)).alias("g"), "times").join(ratios, "g", "left")
    both = hit.where("hit").select("word", "times", *RATIOS).unionByName(missed.select("word", "times", *RATIOS))
    exact = both.groupBy("word").agg(*[F.sum(F.coalesce(F.col(c).cast("float").cast("double"), F.lit(0.0)) * F.col("times")).alias(c) for c in RATIOS])
    # as np.logaddexp does it, so that large ratios don't overflow
    rest, toxic = F.lit(math.log1p(-MIXED)), lambda c: F.lit(math.log(MIXED)) + F.col(c)
    added = exact.select("word", *[(F.greatest(rest, toxic(c)) + F.log1p(F.exp(-F.abs(rest - toxic(c))))).alias(c) for c in RATIOS])
    met = held.join(added, "word", "left")
    sums = met.groupBy("doc_id", "digest").agg(
        F.sum(F.when(F.col("word") == "", F.col("n"))).alias("copies"),
        F.sum(F.when(F.col("word") != "", F.col("n"))).alias("n_words"),
        *[F.sum(F.col(c) * F.col("n")).alias(c) for c in RATIOS],
    )
    size = F.pow(F.greatest(F.coalesce(F.col("n_words") / F.col("copies"), F.lit(1.0)), F.lit(1.0)), F.lit(LENGTH)) * F.col("copies")
    scored = sums.select("doc_id", *[(F.coalesce(F.col(c), F.lit(0.0)) / size).alias(c) for c in RATIOS], "copies")
    return scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _bin(value: Column) -> Column:
    place = (F.asinh(value / UNIT) - LOW) / (HIGH - LOW)
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(place * BINS).cast("int")))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, log_ratio) for every row of docs; score is the calibrated chance of label 1, log_ratio the length-normalised comparison it comes from.

    Learns from the labels of rows whose crc32 of the id as text doesn't leave 1 when divided by 3; of several labels of an id the highest counts. Null labels and ids teach nothing.
    Texts without words, null and empty ones too, have ratio 0; those of any length are taken whole. Repeated ids give a row each. Without labels of both classes every
    score is 0.5. Columns not named are ignored. No documents: no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("y")).where("doc_id is not null and y is not null")
    given = written(given.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "labels")
    if given.select("y").distinct().count() < 2:
        return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"), F.lit(0.0).alias("log_ratio"))
    near = with_broadcast_if(given, BROADCAST_ROWS)
    kinds = written(training_words(rows.join(near, "doc_id")), "words")
    ratios = written(log_ratios(kinds), "ratios")
    scored = written((_by_arrays if small_enough(ratios, MODEL_ROWS) else _by_joins)(rows, ratios), "scored")

    learnt = scored.join(near, "doc_id").withColumn("other", F.element_at(F.array(*RATIOS[1:]), F.col("fold") + 1))
    total, ones = np.zeros(BINS), np.zeros(BINS)
    for r in learnt.groupBy(_bin(F.col("other")).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect():  # BINS rows at most
        total[r["bin"]], ones[r["bin"]] = r["n"], r["y"]
    steps = isotonic(total, ones)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ratio = b.column(2).to_numpy(zero_copy_only=False)
            place = np.clip((np.arcsinh(ratio / UNIT) - LOW) / (HIGH - LOW), 0, 1)
            # a small part keeps the order within a step
            score = 0.99 * np.interp(place, (np.arange(BINS) + 0.5) / BINS, steps) + 0.01 * place
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), b.column(2)], ["doc_id", "held_out", "score", "predicted", "log_ratio"])

    schema = StructType([StructField("doc_id", LongType()), StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("log_ratio", DoubleType())])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "ratio").mapInArrow(run, schema)


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
