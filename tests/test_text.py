import pytest
from helpers import values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizmill.functions import chunking, text

def T():  # noqa: N802
    return F.col("t")



def one_clean(raw):
    """A plain version of cleaning, one line at a time."""
    seen, out = set(), []
    for line in (raw or "").splitlines():
        line = line.strip()
        if line and line not in seen:
            seen.add(line)
            if out and len(line) < 40:
                out[-1] += " " + line
            else:
                out.append(line)
    import re

    return re.sub(r"[ \t]+", " ", "\n\n".join(out)).strip()


TEXTS = ["", "   ", "one", "Budget\nat\na\nGlance", "a\n" + "x" * 50 + "\nb\r\na\n\n  b  \x0bc", "é tab\t\tz line\x85next ", "x" * 45 + "\n" + "x" * 45, None, "A.  B!\nC? d"]


def test_clean_and_counts(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    got = {r["k"]: r for r in rows.select("k", text.clean(T()).alias("c"), text.word_count(T()).alias("n")).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k]["c"] == one_clean(t) and got[k]["n"] == len((t or "").split())


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab .!?\n\t é"), max_size=60), min_size=1, max_size=20))
def test_clean_and_semantic_chunks_of_random_texts(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = sorted(rows.select("k", text.clean(T()), text.sentences(T()), chunking.semantic(T(), 12, 0.5)).collect())
    import re

    for k, c, s, chunks in got:
        assert c == one_clean(texts[k])
        expected = [x.strip() for x in re.split(r"(?<=[.!?])\s+", texts[k]) if x.strip()]
        assert s == expected
        assert chunks == ([] if not texts[k].strip() else chunking.semantic_lists(expected, 12, 0.5) or [texts[k]])


@pytest.mark.parametrize(
    "t,size,overlap,starts",
    [("", 100, 20, []), ("  ", 100, 20, []), ("short", 100, 20, [0]), ("a" * 500 + "b" * 500 + "c" * 500, 400, 50, [0, 350, 700, 1050, 1400]), ("x" * 2000, 500, 50, [0, 450, 900, 1350, 1800])],
)
def test_fixed_chunks(spark, t, size, overlap, starts):
    assert values(spark, chunking.fixed(T(), size, overlap), t=t) == [t[s : s + size] for s in starts]


def test_fixed_needs_a_step():
    with pytest.raises(ValueError):
        chunking.fixed(T(), 100, 100)


def test_semantic_chunks(spark):
    assert values(spark, chunking.semantic(T(), 1000, 0.2), t="One. Two. Three.") == ["One. Two. Three."]
    long = "x" * 300
    assert values(spark, chunking.semantic(T(), 100, 0.2), t=f"{long}. A b. {long}!") == [f"{long}.", "A b.", f"A b. {long}!"]
    docs = spark.createDataFrame([(1, "One. " * 5000), (2, None), (3, "")], "k int, t string")
    both = docs.select("k", chunking.semantic(T(), 1500, 0.2).alias("c")).join(chunking.semantic_arrow(docs, "t", 1500, 0.2), "k").collect()
    assert all(r["c"] == r["chunks"] for r in both) and len(both) == 3


def test_books_are_cut_a_few_at_a_time(spark, monkeypatch):
    long = "x" * 300
    given = [None, "One. Two. Three.", f"{long}. A b. {long}!", "  ", "no end", f"é. {long} ü? " * 40, *(". ".join("abcdefgh" * (k % 9) for k in range(n)) for n in range(60))]
    docs = spark.createDataFrame(list(enumerate(given)), "k int, t string").coalesce(1)
    monkeypatch.setattr(chunking, "SLICE", 8)
    made = chunking.semantic_arrow(docs, "t", 100, 0.2)
    both = docs.select("k", chunking.semantic(T(), 100, 0.2).alias("c")).join(made, "k").collect()
    assert len(both) == len(given) and all(r["c"] == r["chunks"] and r["t"] == given[r["k"]] for r in both)
    # whole batches as objects of Python were what grew
    assert "MapInPandas" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("c,score", [("The correct answer is A.", 1.0), ("incorrect key", 0.0), ("key is wrong", 0.0), ("Wrong answer.", 0.7), ("", 0.5), (None, 0.5), ("Looks fine.", 0.7)])
def test_critique_score(spark, c, score):
    assert values(spark, text.critique_score(F.col("c").cast("string")), c=c) == score


@pytest.mark.parametrize("given_,critique,valid,score", [(None, "", None, 0.5), ("1.7", "", True, 1.0), ("0.9", "", False, 0.3), ("nan?", "incorrect key", True, 0.0)])
def test_final_score(spark, given_, critique, valid, score):
    assert values(spark, text.final_score(F.col("g").cast("string"), F.col("c"), F.col("v").cast("boolean")), g=given_, c=critique, v=valid) == score


@pytest.mark.parametrize("n,expected", [("7", 7), ("7.9", 7), (None, 15), ("x", 15), ("0", 1), ("99", 20)])
def test_clamp(spark, n, expected):
    assert values(spark, text.clamp(F.col("n").cast("string"), 15), n=n) == expected


def test_sampled_questions(spark):
    paper = "1. Which of the following statements is/are correct?\nA. Statement one\nB. Statement two\n2. Consider the following pairs?\n\n   block   of more  than twenty characters\n"
    got = values(spark, text.sampled_questions(T()), t=paper)
    assert got[0] == "1. Which of the following statements is/are correct?" and "Which of the following statements is/are correct?" in got
    assert "block of more than twenty characters" in got and len(got) == len(set(got))
    many = "\n".join(f"{k}) what is the value of item number {k}?" for k in range(50))
    assert len(values(spark, text.sampled_questions(T()), t=many)) == 30
    assert values(spark, text.numbered(F.array(F.lit("a"), F.lit("b")))) == "1. a\n2. b"


def test_options_by_label(spark):
    labels, texts = F.array(*map(F.lit, ["b ", "A", "a", "AB", ""])), F.array(*map(F.lit, "vwxyz"))
    assert values(spark, text.options_by_label(labels, texts)) == {"B": "v", "A": "x"}


def test_keys(spark):
    assert values(spark, text.content_key(T()), t="abc") == "900150983cd24fb0d6963f7d28e17f72"
    assert values(spark, text.seed(T()), t="abc") == "ba7816bf"
    a = values(spark, text.stable_id(F.lit("x"), F.lit("1")))
    assert len(a) == 36 and a == values(spark, text.stable_id(F.lit("x"), F.lit("1")))


def test_timeouts_and_contexts(spark):
    assert [values(spark, text.timeout_s(F.lit(n))) for n in (0, 9, 10, 35)] == [1200, 1200, 1260, 1380]
    assert values(spark, text.context(F.lit("o"), F.array(F.lit("a"), F.lit("b")))) == "Document outline:\no\n\na\n\nb"
    assert values(spark, text.context(F.lit(""), F.array(F.lit("a")))) == "a"


def test_chunks_of_many_sentences(spark):
    """Several blocks of the fold, at and around their ends, and sentences longer than a chunk."""
    for n in (1, 255, 256, 257, 1500):
        parts = [f"Sentence {i} has {'very ' * (i % 40)}many words." if i % 97 else "x" * 400 + "." for i in range(n)]
        got = values(spark, chunking.semantic(F.lit(" ".join(parts)), 300, 0.2))
        assert got == chunking.semantic_lists(parts, 300, 0.2)
