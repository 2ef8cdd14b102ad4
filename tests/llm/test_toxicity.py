import math
import zlib
from collections import Counter

import pytest

from quizmill.llm import toxicity
from quizmill.llm.toxicity import ALPHABET, DEPTH, DISCOUNT, END, LENGTH, MIXED, OPEN, START, STRENGTH, log_ratios, op12_toxicity, score_toxicity, words

SF = "/root/testdata/sf0.01"


def plain_ratios(counts):
    """The models by recursion over plain dictionaries: counts[c] has words of class c. (gram or context + OPEN) -> log ratio."""
    n = [Counter(), Counter()]
    for c in (0, 1):
        for w, k in counts[c].items():
            s = START + w + END
            for j in range(1, len(s)):
                n[c][s[max(0, j - DEPTH + 1) : j + 1]] += k
    seen = set(n[0]) | set(n[1])
    parts = {g[k:] for g in seen for k in range(len(g))}
    followed = Counter(g[1:] for g in parts if len(g) > 1)

    def low(g):
        if not g:
            return 1 / ALPHABET
        same = [k for x, k in followed.items() if x[:-1] == g[:-1] and len(x) == len(g)]
        return max(followed[g] - DISCOUNT, 0) / sum(same) + DISCOUNT * len(same) / sum(same) * low(g[1:])

    def stats(table, h):
        found = [k for g, k in table.items() if g[:-1] == h and k]
        return sum(found), len(found)

    pool, out = n[0] + n[1], {}
    for h in {g[:-1] for g in seen}:
        (s0, k0), (s1, k1), (s, k) = stats(n[0], h), stats(n[1], h), stats(pool, h)
        rest = [(STRENGTH + DISCOUNT * k0) / (s0 + STRENGTH), (STRENGTH + DISCOUNT * k1) / (s1 + STRENGTH)]
        out[h + OPEN] = math.log(rest[1] / rest[0])
        for g in (g for g in seen if g[:-1] == h):
            both = (max(pool[g] - DISCOUNT, 0) + DISCOUNT * k * low(g[1:])) / s
            p = [max(n[c][g] - DISCOUNT, 0) / ((s0, s1)[c] + STRENGTH) + rest[c] * both for c in (0, 1)]
            out[g] = math.log(p[1] / p[0])
    return out


def plain_score(ratios, text):
    total = 0.0
    for w, times in words(text).items():
        s = START + w + END
        r = 0.0
        for j in range(1, len(s)):
            g = s[max(0, j - DEPTH + 1) : j + 1]
            r += ratios.get(g, ratios.get(g[:-1] + OPEN, 0.0))
        total += times * math.log(1 - MIXED + MIXED * math.exp(r))
    return total / max(1, words(text).total()) ** LENGTH


DOCS = [(k, ["you vile fool", "fine day here", "a fool's day, really fine", "VILENESS abounds", "dáy für Ähre"][k % 5] + f" no {chr(97 + k % 7)}b") for k in range(40)]
LABELS = [(k, int(k % 5 in (0, 3))) for k in range(36)]


def test_same_as_plain_models(spark, monkeypatch):
    extra = [(40, None), (41, ""), (42, "12 34"), (43, "fool " * 30000 + "x" * 50000), (2, "other text of a known id, fool"), (None, "vile"), (43, "twice"), (43, "twice")]
    rows = DOCS + extra
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, word string, y int").repartition(3)
    labels = spark.createDataFrame([*LABELS, (2, None), (None, 1), (40, None), (99, 1), (3, 0)], "doc_id long, toxic int")
    counts = [Counter(), Counter()]
    for i, t in rows:
        y = dict(LABELS).get(i)
        if y is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            counts[y].update(words(t).keys())
    ratios = plain_ratios(counts)
    expected = sorted((str(i), round(plain_score(ratios, t), 6)) for i, t in rows)
    for limit in (toxicity.MODEL_ROWS, 0):
        monkeypatch.setattr(toxicity, "MODEL_ROWS", limit)
        got = score_toxicity(docs, labels).collect()
        assert sorted((str(r["doc_id"]), round(r["log_ratio"], 6)) for r in got) == expected
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_ratios_by_fold_leave_the_fold_out(spark):
    kinds = spark.createDataFrame([("vile", 1, 0, 2, 5), ("vim", 3, 2, 0, 1), ("day", 4, 4, 0, 0)], "word string, n00 long, n01 long, n10 long, n11 long")
    got = {r["g"]: r for r in log_ratios(kinds).collect()}
    all_of = plain_ratios([Counter(vile=1, vim=5, day=8), Counter(vile=7, vim=1)])
    assert got.keys() == all_of.keys() and all(abs(got[g]["ratio"] - v) < 1e-9 for g, v in all_of.items())
    # grams of words that only the left-out fold has still back off to what both folds have
    only = plain_ratios([Counter(vile=0, vim=2, day=4), Counter(vile=5, vim=1)])
    assert all(abs(got[g]["ratio0"] - only[g]) < 1e-9 for g in only if g.endswith(OPEN))


def test_small_caches_change_nothing(spark, monkeypatch):
    docs, labels = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(LABELS, "doc_id long, toxic int")
    before = sorted(map(tuple, score_toxicity(docs, labels).collect()))
    monkeypatch.setattr(toxicity, "CACHED", 3)
    monkeypatch.setattr(toxicity, "PIECE", 2)
    assert sorted(map(tuple, score_toxicity(docs, labels).collect())) == before


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    labels = spark.createDataFrame(LABELS, "doc_id long, toxic int")
    for some in (labels.limit(0), labels.where("toxic = 1")):
        assert {(r["score"], r["predicted"]) for r in score_toxicity(docs, some).collect()} == {(0.5, 0)}
    assert score_toxicity(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.55), ("sf0.1", 0.85)])
def test_held_out_accuracy(spark, sf, least):
    got = {r["doc_id"]: r for r in op12_toxicity(spark, f"/root/testdata/{sf}").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").collect()}
    held = [(got[d]["predicted"], y) for d, y in labels.items() if got[d]["held_out"] and y is not None]
    caught = sum(p and y for p, y in held)
    assert caught >= least * sum(y for _, y in held) and sum(p and not y for p, y in held) <= 0.01 * len(held)
