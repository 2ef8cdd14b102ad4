"""Learned ends of sentences against plain counting."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from quizmill.functions.text import sentences
from quizmill.operators import boundaries
from quizmill.operators.boundaries import abbreviations, learned_sentences

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(boundaries.WORD)


def plain(texts):
    n, ended = Counter(), Counter()
    for t in texts:
        for w in re.split(r"\s+", t or ""):
            if WORD.match(w):
                kind = (w[:-1] if w.endswith(".") else w).translate(LOW)
                n[kind] += 1
                ended[kind] += w.endswith(".")
    share = sum(ended.values()) / sum(n.values())
    out = set()
    for kind, c in n.items():
        a, periods = ended[kind], kind.count(".")
        ll = -2 * (a * math.log(share) + (c - a) * math.log(1 - share) - a * math.log(0.99) - (c - a) * math.log(0.01))
        if a and ll * math.exp(-(len(kind) - periods)) * (periods + 1) * float(len(kind) - periods) ** -(c - a) >= 0.3:
            out.add(kind)
    return out


TEXTS = ["The firm of Dr. Brown met at ca. noon. It was late. Prof. Grey left, e.g. by train. He slept."] * 6 + [
    "Rivers flow by the old town and on to the sea. The sea is wide and cold and old. No one swims there now, or so they say.",
    "An end. A start! Why? The U.S. team won at no. 5 in the end. It rained at the end of the day and the night.",
    None,
    "",
    "no period",
] * 3


def test_abbreviations_are_learned(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "id long, text string, type string").repartition(4)
    got = {r["type"] for r in abbreviations(docs, "text").collect()}
    assert got == plain(TEXTS) and {"dr", "ca", "e.g"} <= got and not {"end", "late", "sea"} & got


def test_sentences_go_on_after_abbreviations(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "Lost. Row.", "x"), (999, "At ca. noon. " * 700, "x")], "id long, text string, part string").repartition(4)
    short = plain(TEXTS + ["Lost. Row.", "At ca. noon. " * 700])
    cut = {r["id"]: r["s"] for r in docs.where("id is not null").select("id", sentences(F.col("text")).alias("s")).collect()}
    expected = []
    for i, parts in cut.items():
        held, k = [], 0
        for p in parts:
            held.append(p)
            last = re.split(r"\s+", p)[-1]
            if not (last.endswith(".") and WORD.match(last) and last[:-1].translate(LOW) in short):
                expected.append((i, k, " ".join(held)))
                held, k = [], k + 1
        if held:
            expected.append((i, k, " ".join(held)))
    for limit in (boundaries.BROADCAST_ROWS, 0):
        monkeypatch.setattr(boundaries, "BROADCAST_ROWS", limit)
        got = sorted(map(tuple, learned_sentences(docs, "id", "text", piece=50).collect()))
        assert got == sorted(expected)
    assert any(s.startswith("The firm of Dr. Brown met at ca. noon.") for _, _, s in got)
    assert learned_sentences(docs.limit(0), "id", "text").collect() == []


def test_sentences_are_cut_in_place_or_by_shuffles(spark, monkeypatch):
    given = [*TEXTS, "  At ca.\n noon.\nA line\nmore", "It ends ca.", "ca. ca.", "One!\tTwo?  Dr. \u2003Who", "\n", None]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(given)], "id long, text string, part string").repartition(4)
    known = spark.createDataFrame([("ca",), ("dr",), ("unused",)], "type string")
    found = []
    for limit in (boundaries.LISTED_ROWS, 0):
        monkeypatch.setattr(boundaries, "LISTED_ROWS", limit)
        for few in (known, None):
            made = learned_sentences(docs, "id", "text", few, piece=3)
            found.append(sorted(map(tuple, made.collect())))
            assert ("Exchange hashpartitioning" in made._jdf.queryExecution().executedPlan().toString()) is (limit == 0)
    assert found[0] == found[2] and found[1] == found[3] and len(found[0]) != len(found[1])
    assert (len(TEXTS), 0, "At ca. noon.") in found[0] and (len(TEXTS), 1, "A line\nmore") in found[0]
