import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quizmill.llm import suffix
from quizmill.llm.suffix import anchors, common_prefixes, merged, op5_suffix_dedup, remove_repeats, suffix_array


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_and_prefixes(values):
    t = np.array(values, np.int64)
    sa = suffix_array(t)
    assert sa.tolist() == sorted(range(len(values)), key=lambda i: values[i:])
    plcp = common_prefixes(t, sa) if len(t) else []
    for x, y in zip(sa, sa[1:], strict=False):
        k = 0
        while max(x, y) + k < len(t) and t[x + k] == t[y + k]:
            k += 1
        assert plcp[y] == k


def brute(rows):
    """rows: (doc_id, text) in order."""
    seen, out = set(), []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 99):
            s = data[k : k + 100]
            if s in seen:
                gone[k : k + 100] = True
            seen.add(s)
        gone[-1] = False
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        starts = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(data)]).sum())
        out.append((doc, len(data), len(data) - len(kept), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in df.collect()), key=str)


def test_the_query(spark, sf):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    expected = brute(rows)
    assert sorted(map(tuple, op5_suffix_dedup(spark, sf).collect()), key=str) == expected
    assert sum(r[2] > 0 for r in expected) > 5


def hard():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    a, b, c = word(400), word(150), word(99)
    return [
        (1, a), (2, word(50) + a[100:350] + word(60)), (3, None), (4, ""), (5, c), (6, c), (7, c + "x"), (8, "y" + c + "x"),
        (9, "z" * 5000), (10, "z" * 150), (11, "ab" * 400), (12, b + b), (13, b + word(7) + b[:120]), (14, a), (15, a[:200] + b + a[200:]),
        (16, "\0" * 300), (17, "\0" * 120 + "\1" * 300), (18, word(30000)), (19, "é" * 120),
    ]


@pytest.mark.parametrize("hot,chunk,rows", [(20_000, 1 << 19, 1_000_000), (1, 256, 0), (3, 1 << 19, 0)])
def test_overlaps_periods_nulls_and_extra_columns(spark, monkeypatch, hot, chunk, rows):
    monkeypatch.setattr(suffix, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(suffix, "BROADCAST_KEYS", rows)
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    rows = hard()
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, row int, spans string").repartition(3)
    assert got(remove_repeats(docs)) == brute(rows)


def test_repeated_and_null_ids(spark):
    text = hard()[0][1]
    docs = spark.createDataFrame([(2, text), (None, text), (2, text), (3, "short")], "doc_id long, text string")
    assert got(remove_repeats(docs)) == brute([(None, text), (2, text), (2, text), (3, "short")])
    assert got(remove_repeats(docs.limit(0))) == []


def test_anchors_depend_on_the_string_only():
    rng = random.Random(1)
    a = bytes(rng.choice(b"abc") for _ in range(500))
    h1, f1, l1 = anchors(a)
    h2, f2, l2 = anchors(b"q" * 77 + a)
    chosen = lambda h, f, l: {s: x for x, p, q in zip(h.tolist(), f.tolist(), l.tolist(), strict=True) for s in range(p, q + 1)}  # noqa: E731, E741
    one, two = chosen(h1, f1, l1), chosen(h2, f2, l2)
    assert all(one[s] == two[s + 77] for s in range(401)) and len(one) == 401


def test_merged():
    a, b = merged(np.array([5, 0, 3, 20]), np.array([8, 3, 4, 21]))
    assert a.tolist() == [0, 5, 20] and b.tolist() == [4, 8, 21]


@pytest.mark.parametrize("waves", [0, 10**6])
@pytest.mark.parametrize("letters", [2, 300, 100_000])
def test_suffix_array_of_repeated_names_at_any_depth(monkeypatch, waves, letters):
    """By buckets and suffix by suffix; texts that repeat whole, so that names repeat at every level."""
    monkeypatch.setattr(suffix, "WAVES", waves)
    rng = np.random.default_rng(letters)
    for n in (0, 1, 40, 700):
        t = rng.integers(0, letters, n)
        t = np.concatenate([t, t, t[: n // 2], rng.integers(0, letters, n // 3), t])
        values = t.tolist()
        assert suffix_array(t).tolist() == sorted(range(len(values)), key=lambda i: values[i:])
