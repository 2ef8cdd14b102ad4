import zlib

import numpy as np
import pytest

from quizmill.llm.quality import BINS, N_STATISTICS, Model, RandomFeatures, accepted, isotonic, op3_quality, score_quality, statistics


def test_isotonic_is_monotone_and_keeps_means():
    rng = np.random.default_rng(0)
    n = rng.integers(0, 5, BINS).astype(float)
    y = np.minimum(n, rng.integers(0, 5, BINS)).astype(float)
    fit = isotonic(n, y)
    assert (np.diff(fit) >= 0).all() and abs((fit * n).sum() - y.sum()) < 1e-6
    assert isotonic(np.array([2.0, 0, 2]), np.array([1.0, 0, 2])).tolist() == [0.75, 0.75, 0.75] or isotonic(np.array([2.0, 0, 2]), np.array([1.0, 0, 2]))[0] <= 1


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, N_STATISTICS))
    phi = RandomFeatures(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    z = phi(x)[:, : phi.w.shape[1]]
    scale = 1 / (np.sqrt(N_STATISTICS) * 1.5)
    exact = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1) * scale**2)
    assert np.abs(z @ z.T - exact).mean() < 0.08


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op3_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in rows.items())
    held = [(rows[d]["score"], q) for d, q in labels.items() if rows[d]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    right = np.mean([(s >= 0.3) == q for s, q in held])
    assert auc > 0.95 and right > 0.93


def test_nulls_ties_empty_and_extra_columns(spark):
    rows = [(1, "fine words here"), (1, "fine words here"), (2, None), (3, ""), (None, "x"), (4, "y " * 50000)]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, x int")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, None, 1), (None, 1, 1), (99, 0, 0), (1, 1, 0)], "doc_id long, quality int, held_out int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 6 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert {r["score"] for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).collect() == []
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_accepted_by_unique_ids(spark):
    rows = [(k, "!! " * 40 if k % 3 == 0 else f"plain words of text number {k} " * 8) for k in range(60)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, `rejected_` string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(60)], "doc_id long, quality int")
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(60) if k % 3]


def test_statistics_use_the_whole_text():
    assert len(statistics("a")) == N_STATISTICS == len(statistics(None))
    assert statistics("a " * 20000 + "!!") != statistics("a " * 20000 + "ab")
    assert isinstance(Model(None, np.zeros(1)), Model)


@pytest.mark.parametrize("text", ["", None])
def test_empty(text):
    assert statistics(text) == [0.0] * N_STATISTICS


def brute(rows):
    """Features and normal equations of (doc_id, text, label or None) by plain numpy, all rows at once."""
    from quizmill.llm.quality import HIGH, LOW, PENALTY

    x = np.array([statistics(t) for _, t, _ in rows], np.float32).astype(float)
    learn = np.array([y is not None and zlib.crc32(str(d).encode()) % 5 != 0 for d, _, y in rows])
    y = np.array([y or 0 for _, _, y in rows], float)
    phi = RandomFeatures(x[learn].mean(axis=0), x[learn].std(axis=0))
    z = phi(x)
    solve = lambda pick: np.linalg.solve(z[pick].T @ z[pick] + PENALTY * pick.sum() * np.eye(z.shape[1]), z[pick].T @ y[pick])
    return z, y, learn, solve, LOW, HIGH


def test_scores_against_plain_numpy(spark):
    from pyspark.sql import functions as F

    from quizmill.llm.quality import FOLDS

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(r["doc_id"], r["text"], known.get(r["doc_id"])) for r in docs.collect()]
    folds = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))).collect()}
    z, y, learn, solve, low, high = brute(rows)
    raw = z @ solve(learn)
    fold = np.array([folds[d] for d, _, _ in rows])
    apart = np.zeros(len(rows))
    for k in range(FOLDS):
        apart[fold == k] = (z @ solve(learn & (fold != k)))[fold == k]
    at = np.clip((apart[learn] - low) / (high - low) * BINS, 0, BINS - 1).astype(int)
    # isotonic means as the largest of the least means over all spans of bins that hold a bin
    n, ones = np.bincount(at, minlength=BINS), np.bincount(at, y[learn], BINS)
    used = np.flatnonzero(n)
    up = np.array([max(min(ones[used[i : j + 1]].sum() / n[used[i : j + 1]].sum() for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))])
    steps = isotonic(n.astype(float), ones)
    assert np.allclose(steps[used], up)
    centres = low + (np.arange(BINS) + 0.5) * (high - low) / BINS
    clipped = np.clip(raw, low, high)
    expected = np.clip(0.99 * np.interp(clipped, centres, steps) + 0.01 * (clipped - low) / (high - low), 0, 1)
    got = {r["doc_id"]: r["score"] for r in score_quality(docs, labels).collect()}
    assert max(abs(got[d] - e) for (d, _, _), e in zip(rows, expected, strict=True)) < 1e-4
