import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from quizmill.llm.simhash import _moves, near_duplicates, one_of_each_group, spanning_forest, tile_links


def brute_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows, radius=3):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, f"{p:016x}", min(least[find(i)], default=None)) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def test_against_brute_force_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=str) == brute(rows)


def test_nulls_ties_empty_and_extra_columns(spark):
    long = "word another third " * 5000
    rows = [(5, "One two three four five six"), (3, "one TWO three four five six"), (9, None), (8, ""), (7, " \n\t"), (None, "lonely text"), (1, "x"), (1, "x"), (2, long), (4, "Été été")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, fp string, word int")
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=str) == brute(rows)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_tile_links_span_the_same_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).view(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 10)).astype(np.uint64)
    a = (base[:, None] ^ flips).reshape(-1, 1)
    u, v, w = tile_links(a, None, (2,))
    assert len(u) == 360 and (w <= 2).all()
    u, v, _ = tile_links(a[:200], a[200:], (2,))
    assert len(u) == 0
    assert len(spanning_forest(4, np.array([0, 1, 0, 2]), np.array([1, 2, 2, 3]), np.array([1, 1, 0, 5]))) == 3


@pytest.mark.parametrize("dims,radius", [(1, 3), (2, 3)])
def test_moves_cover_each_direction_once(dims, radius):
    moves = {tuple(m) for m in _moves(dims, radius)}
    assert all(tuple(-x for x in m) not in moves or not any(m) for m in moves)
    full = [(x,) for x in range(-3, 4)] if dims == 1 else [(x, y) for x in range(-3, 4) for y in range(-3, 4) if abs(x) + abs(y) <= radius]
    assert 2 * len(moves) - 1 == len(full)


def jaccard_groups(rows, size=5, similarity=0.8):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def test_one_of_each_group_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == jaccard_groups(rows)


def test_one_of_each_group_of_variants_nulls_and_ties(spark):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for group in range(4):
        base = [word() for _ in range(300)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(12):
            copy = list(base)
            for k in rng.sample(range(300), 3):
                copy[k] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(100, None), (101, ""), (102, " "), (103, "one two"), (104, "ONE two"), (105, "one three"), (106, "x " * 20000)]
    docs = spark.createDataFrame([(*r, "z", 0) for r in rows], "doc_id long, text string, row string, fp int")
    assert sorted(r["doc_id"] for r in one_of_each_group(docs).collect()) == jaccard_groups(rows)
    twice = one_of_each_group(docs.unionByName(docs))
    assert sorted(r["doc_id"] for r in twice.collect()) == jaccard_groups(rows)
    assert one_of_each_group(docs.limit(0)).collect() == []


@pytest.mark.parametrize("within", [True, False])
def test_sub_tiles_lose_no_link(monkeypatch, within):
    from quizmill.llm import simhash

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    rows = np.concatenate([base, base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ np.uint64(1 << 40), rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)]).reshape(-1, 1)
    rng.shuffle(rows)
    a, b = (rows, None) if within else (rows[:400], rows[400:])
    plain = tile_links(a, b, (3,))
    monkeypatch.setattr(simhash, "SUBTILED", 0)
    fine = tile_links(a, b, (3,))
    both = a if b is None else np.concatenate([a, b])
    assert len(plain[0]) == len(fine[0]) > 50
    assert (np.bitwise_count(both[fine[0], 0] ^ both[fine[1], 0]) == fine[2]).all()
    assert sorted(plain[2]) == sorted(fine[2])


def on_a_template(rng, singles, partners):
    """Documents at a similarity of 0.75 to each other, by their order, the last ones with a partner at 0.85 each."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template, rows = [word() for _ in range(344)], []
    for k in range(singles + partners):
        own = [word() for _ in range(57)]
        rows.append((len(rows), " ".join(template + own)))
        if k >= singles:
            rows.append((len(rows), " ".join(template + own[:-31] + [word() for _ in range(31)])))
    return rows


@pytest.mark.parametrize("block", [500_000, 9_000])
def test_links_are_found_among_candidates_that_fail(spark, monkeypatch, block):
    import random

    from quizmill.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = on_a_template(random.Random(3), 40, 20)
    groups = jaccard_groups(rows)
    assert len(groups) == 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in one_of_each_group(docs).collect()) == groups


def test_documents_of_equal_sketches_stay(spark):
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(100)) + " - " * 130) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in one_of_each_group(docs).collect()) == jaccard_groups(rows) == list(range(6))


def test_repeats_hide_no_pair(spark):
    words, line = " ".join(f"w{i}" for i in range(200)), " ".join(f"l{i}" for i in range(10))
    rows = [(1, f"{words} {line} {line}"), (2, f"{words} {' '.join([line] * 20)}"), (3, f"{words} {' '.join([line] * 40)}"), (4, f"{words} z {' '.join([line] * 40)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in one_of_each_group(docs).collect()] == jaccard_groups(rows) == [1]
