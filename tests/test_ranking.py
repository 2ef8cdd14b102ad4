"""Central sentences and vectors of words against dense versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizmill.functions import embedding
from quizmill.functions.ranking import DAMPING, STEPS, WORD, best_sentences, centralities, ranked
from quizmill.functions.text import sentences
from quizmill.operators.style import outlines
from quizmill.plans.catalog import QUERIES
from quizmill.providers import ExtractiveProvider


def dense(parts):
    """The walk by its whole matrix of sentences."""
    n = len(parts)
    held = [set(WORD.findall(p.lower())) for p in parts]
    p = np.zeros((n, n))
    for i, words in enumerate(held):
        for w in words:
            holders = [j for j in range(n) if w in held[j]]
            for j in holders:
                p[i, j] += 1 / len(words) / len(holders)
        if not words:
            p[i] = 1 / n
    at = np.full(n, 1 / n)
    for _ in range(STEPS):
        at = (1 - DAMPING) / n + DAMPING * (at @ p)
    return at


TEXTS = [["Rivers carve valleys.", "Valleys hold rivers and towns.", "A b 1.", "Towns trade by rivers."], [], ["Alone here."], ["12 3.", "?"], ["Same same words.", "Same same words.", "Other thing."] * 4]


def test_centralities_are_those_of_the_matrix():
    got = centralities(TEXTS)
    assert [len(g) for g in got] == [len(t) for t in TEXTS]
    for g, t in zip(got, TEXTS, strict=True):
        assert not t or (np.allclose(g, dense(t), atol=1e-12) and abs(g.sum() - 1) < 1e-9)
    assert centralities([]) == [] and [len(x) for x in centralities([[], []])] == [0, 0]
    assert best_sentences(TEXTS[4], got[4], 3) == sorted(np.lexsort((np.arange(12), -np.round(dense(TEXTS[4]), 9)))[:3].tolist())


def test_outline_ranked_is_that_of_dense_walks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000")
    parts = {r["doc_id"]: r["s"] for r in docs.select("doc_id", sentences(F.col("text")).alias("s")).collect()}
    got = {}
    for r in QUERIES["outline_ranked"](spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["sentence_ix"], r["sentence"], r["centrality"]))
    for d, s in parts.items():
        c = dense(s) if s else np.zeros(0)
        assert [(i, t) for i, t, _ in got.get(d, [])] == [(i, s[i]) for i in best_sentences(s, c, 10)]
        assert all(abs(x - c[i]) < 2e-9 for i, _, x in got.get(d, []))


def test_ranked_keeps_columns_and_takes_nulls(spark):
    rows = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "One sentence. " * 3000, "z"), (3, "Hi there you. Hi there me.", "z")], "doc_id long, text string, parts string")
    got = ranked(rows, "text", 2).collect()
    assert sorted(len(r["central"]) for r in got) == [0, 0, 2, 2] and all(r["parts"] == "z" for r in got)


def test_outlines_of_the_extractive_provider(spark):
    text = "Rivers carve valleys. Nothing. Valleys hold rivers. Rivers feed valleys."
    chunks = spark.createDataFrame([(1, 10, k, text) for k in range(10)], "doc_id long, n_chunks long, chunk_ix int, text string")
    out = outlines(chunks, "doc_id", "extractive").first()["outline"].split("\n")
    parts = re.split(r"(?<=[.!?])\s+", text)
    best = best_sentences(parts, dense(parts), 2)
    assert out == [f"Chunk {k + 1}: {' '.join(parts[i] for i in best)}" for k in range(10)] and ExtractiveProvider().summarize([""]) == [""]


def plain_vectors(texts):
    held = [[w for w in t.split() if w] for t in (re.sub("[A-Z]", lambda m: m[0].lower(), x or "") for x in texts)]
    n, of = len(held), Counter(w for h in held for w in set(h))
    def vector(words):
        v = np.zeros(embedding.DIM)
        for w in words:
            if w in of:
                digest = hashlib.md5(w.encode()).hexdigest()
                v[int(digest[:7], 16) % embedding.DIM] += (1 if digest[31] < "8" else -1) * (math.log((1 + n) / (1 + of[w])) + 1)
        return v
    return held, vector


@pytest.mark.parametrize("limit", [embedding.BROADCAST_ROWS, 1])
def test_weighted_vectors_and_similarities(spark, monkeypatch, limit):
    monkeypatch.setattr(embedding, "BROADCAST_ROWS", limit)
    texts = ["Rivers carve the valleys", "the the the law", "", None, "law of rivers É é", "word " * 5000, "rivers law"]
    frame = spark.createDataFrame([(k, t, k % 2, "z") for k, t in enumerate(texts)], "id long, text string, goal_id int, word string").repartition(3)
    goals = spark.createDataFrame([(0, "LAW rivers unknownword"), (1, "nothing known")], "goal_id int, goal string")
    held, vector = plain_vectors(texts)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    made = embedding.weighted_vectors(frame, embedding.word_weights(frame, "text"), ["id"], "text").collect()
    assert {r["id"] for r in made} == {0, 1, 4, 5, 6}
    assert all(np.allclose(r["embedding"], unit(vector(held[r["id"]]))) for r in made)
    aims = [vector(re.sub("[A-Z]", lambda m: m[0].lower(), g).split()) for g in ("LAW rivers unknownword", "nothing known")]
    got = embedding.similarities(frame, goals, ["id"], "goal_id", "text", "goal").collect()
    assert len(got) == len(texts) and all(r["word"] == "z" for r in got)
    assert all(abs(r["similarity"] - float(unit(vector(held[r["id"]])) @ unit(aims[r["id"] % 2]))) < 1e-8 for r in got)


def test_frequent_words_are_broadcast_whatever_the_vocabulary(spark, monkeypatch):
    frame = spark.createDataFrame([(k, f"the law {'river' if k % 2 else 'hill'} w{k} v{k % 7}", k % 2) for k in range(60)], "id long, text string, goal_id int")
    goals = spark.createDataFrame([(0, "law w4 hill"), (1, "river v3")], "goal_id int, goal string")
    found = []
    for limit in (embedding.BROADCAST_ROWS, 4, 0):
        monkeypatch.setattr(embedding, "BROADCAST_ROWS", limit)
        found.append({r["id"]: r["similarity"] for r in embedding.similarities(frame, goals, ["id"], "goal_id", "text", "goal").collect()})
        weights = embedding.word_weights(frame, "text")
        plan = embedding._components(frame, weights, "text", ["id"])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("strategy=broadcast") == (1 if limit > 4 else 2 if limit else plan.count("strategy=broadcast"))
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) > 5
