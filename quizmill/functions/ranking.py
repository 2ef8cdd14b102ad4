"""Sentences of a text by how central they are: a random walk between sentences and the words they share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .text import sentences

#: Chance that the walk goes on from where it is, its steps, and letters that a word needs to count.
DAMPING, STEPS, LEAST_LETTERS = 0.85, 30, 3
WORD = re.compile(r"[^\W\d_]{%d,}" % LEAST_LETTERS)


def centralities(texts: list[list[str]]) -> list[np.ndarray]:
    """For each text, given as its sentences, the walk's chance to be at each of them after STEPS steps.

    From a sentence the walk goes to one of its distinct words (lower-cased), then to one of the text's sentences that hold it; with chance 1 - DAMPING, and where a sentence has no word, to any
    sentence of the text. So sentences weigh as much as they share words, and no pair of sentences is ever made: the work grows with the words. All texts walk at once.
    """
    sizes = [len(t) for t in texts]
    n = sum(sizes)
    if not n:
        return [np.zeros(0) for _ in texts]
    of = np.repeat(np.arange(len(texts)), sizes)
    sentence, word, kinds = [], [], {}
    for k, (text, s) in enumerate(zip(of.tolist(), (s for t in texts for s in t), strict=True)):
        for w in sorted(set(WORD.findall(s.lower()))):
            sentence.append(k)
            word.append(kinds.setdefault((text, w), len(kinds)))
    sentence, word = np.array(sentence, np.int64), np.array(word, np.int64)
    in_sentence, in_text = np.bincount(sentence, minlength=n), np.bincount(word, minlength=len(kinds))
    total = np.array(sizes, float)[of]
    at = 1 / total
    for _ in range(STEPS):
        passed = np.bincount(word, (at / np.maximum(in_sentence, 1))[sentence], minlength=len(kinds)) / np.maximum(in_text, 1)
        arrived = np.bincount(sentence, passed[word], minlength=n)
        lost = np.bincount(of, np.where(in_sentence == 0, at, 0.0), minlength=len(texts))
        at = (1 - DAMPING) / total + DAMPING * (arrived + lost[of] / total)
    return np.split(at, np.cumsum(sizes)[:-1])


def best_sentences(parts: list[str], centrality: np.ndarray, k: int) -> list[int]:
    """Places of the k most central sentences, in order of the text; ties (to 9 places) go to the earlier."""
    return sorted(np.lexsort((np.arange(len(parts)), -np.round(centrality, 9)))[:k].tolist())


def ranked(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """docs with `central` array<struct<sentence_ix, sentence, centrality>>: the k most central sentences of each text, in its order; empty for texts without any."""
    held = docs.withColumn("parts_", sentences(F.col(text_col)))
    item = pa.struct([("sentence_ix", pa.int64()), ("sentence", pa.string()), ("centrality", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                b = batch.slice(low, 256)
                texts = b.column(b.num_columns - 1).to_pylist()
                found = [[{"sentence_ix": i, "sentence": parts[i], "centrality": c[i]} for i in best_sentences(parts, c, k)] for parts, c in zip(texts, centralities(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(item))], [*b.schema.names[:-1], "central"])

    fields = StructType.fromDDL("sentence_ix long, sentence string").add(StructField("centrality", DoubleType()))
    return held.mapInArrow(run, StructType([*docs.schema.fields, StructField("central", ArrayType(fields))]))
