import json
import random
from fractions import Fraction

import pytest
from helpers import values
from pyspark.sql import functions as F

from quizmill import config, providers, schemas
from quizmill.functions import parsing, vectors
from quizmill.operators import export, lifecycle, pages, retrieval, selection, serving, style
from quizmill.sources import files

GOOD = {"A": "a", "B": "b", "C": "c", "D": "d"}
ROW = "k int, cand_ix long, question string, options map<string,string>, correct_option string, difficulty string, critique string, quality_score double"


def candidates(spark, *critiques, **other):
    rows = [(1, i, "Is this a long enough stem?", GOOD, "A", "medium", *(c if isinstance(c, tuple) else (c, None))) for i, c in enumerate(critiques)]
    return spark.createDataFrame(rows, ROW)


def picked(spark, n, *critiques, **more):
    out = selection.select(candidates(spark, *critiques), "k", n, **more).orderBy("sort_order").collect()
    return [r["mode"] for r in out][:1], [r["cand_ix"] for r in out]


def test_selection_modes(spark):
    assert picked(spark, 5, "ok", "ok") == (["strict"], [0, 1])
    assert picked(spark, 5, "incorrect key: B", "Looks fine.") == (["strict"], [1])
    assert picked(spark, 5, "B, C, D are wrong answers", "incorrect answer choices are plausible") == (["strict"], [0, 1])
    assert picked(spark, 2, ("wrong key", 0.1), ("wrong key", 0.9), ("wrong key", 0.5)) == (["quality_fallback"], [1, 2])
    assert picked(spark, 2, "wrong key", "wrong key", ("fine", 0.7)) == (["strict"], [2])
    assert picked(spark, 2) == ([], [])
    assert picked(spark, 1, "custom phrase", phrases=["custom"]) == (["quality_fallback"], [0])


@pytest.mark.parametrize(
    "stem,options,answer,fine",
    [("long enough", GOOD, "a ", True), ("short", GOOD, "A", False), ("long enough", {"A": "a", "B": "b", "C": "c"}, "A", False), ("long enough", GOOD, "E", False), ("long enough", GOOD, "", True), ("long enough", None, "A", False), ("long enough", GOOD | {"D": " "}, "A", False)],
)
def test_shape(spark, stem, options, answer, fine):
    row = spark.createDataFrame([(stem, options, answer)], "q string, o map<string,string>, a string")
    assert row.select(selection.shaped(F.col("q"), F.col("o"), F.col("a"))).first()[0] is fine


@pytest.mark.parametrize("n,k,expected", [(0, 15, []), (3, 15, [0, 1, 2]), (164, 15, [round(i * 163 / 14) for i in range(15)]), (16, 15, sorted({round(i * 15 / 14) for i in range(15)})), (5, 1, [0])])
def test_spread(spark, n, k, expected):
    assert values(spark, retrieval.spread(F.lit(n), k)) == expected


def test_spread_rounds_exact_halves_to_even(spark):
    rows = spark.range(1, 600).select("id", retrieval.spread(F.col("id"), 15).alias("at")).where("id > 15").collect()
    assert all(r["at"] == sorted({round(Fraction(i * (r["id"] - 1), 14)) for i in range(15)}) for r in rows)


def test_limits():
    assert [retrieval.limit(n) for n in (0, 1, 5, 20)] == [1, 3, 15, 15]
    assert providers.candidates_wanted(5) == 7 and providers.candidates_wanted(20) == 20


def test_top_by_keeps_document_order(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.1, 0.9, 0.5, 0.9])], "g int, at int, s double")
    assert [(r["at"], r["place"]) for r in retrieval.top_by(rows, ["g"], F.col("s"), "at", 3).orderBy("place").collect()] == [(1, 1), (2, 2), (3, 3)]


def test_nearest_with_radius(spark):
    rows = spark.createDataFrame([(i, float(d)) for i, d in enumerate([5, 1, 3, 2])], "at int, d double")
    assert sorted(r["at"] for r in retrieval.nearest_l2(rows, "d", "at", 2, 2.5).collect()) == [1, 3]
    assert sorted(r["at"] for r in retrieval.nearest_l2(rows, "d", "at", 2, 0.5).collect()) == [0, 1]
    assert sorted(r["at"] for r in retrieval.nearest_l2(rows, "d", "at", 2, None).collect()) == [1, 3]


def test_vectors_agree(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0])], "k int, v array<float>")
    got = vectors.cosine_to(rows, "v", [3.0, 4.0]).withColumn("s", vectors.cosine(F.col("v"), F.array(F.lit(3.0), F.lit(4.0)))).collect()
    assert all(abs(r["s"] - r["similarity"]) < 1e-9 for r in got)


@pytest.mark.parametrize("raw,n", [("not json", 0), ("[]", 0), ('[{"question": "q"}, 3, null]', 1), ('```json\n{"mcqs": [{"question": 5, "correct_option": 2, "options": {"A": 1, "F": "x"}}]}\n```', 1), ('{"mcqs": 4}', 0), (None, 0), ("```", 0)])
def test_parse(spark, raw, n):
    rows = spark.createDataFrame([(1, raw)], "k int, raw string")
    got = parsing.mcqs(rows, "raw", ["polity"], "k").collect()
    assert len(got) == n
    if raw and "question\": 5" in raw:
        assert got[0]["question"] == "5" and got[0]["correct_option"] == "2" and got[0]["options"] == {"A": "1", "B": "", "C": "", "D": "", "F": "x"}


def test_verdicts(spark):
    one = lambda raw, n: [tuple(v) for v in values(spark, parsing.verdicts(F.col("r").cast("string"), F.lit(n)), r=raw)]
    assert one('[{"is_valid": false, "quality_score": -3, "critique": "c"}]', 2) == [(False, 0.0, "c"), (True, 0.5, "")]
    assert one("{}", 2) == [(False, 0.5, ""), (False, 0.5, "")] and one(None, 1) == [(False, 0.5, "")] and one("[]", 0) == []


def test_unknown_topics_get_the_first(spark):
    from quizmill.sources.tables import topics

    rows = spark.createDataFrame([("Economy ",), ("?",), (None,)], "topic_tag string")
    assert sorted(r["topic_id"] for r in selection.with_topics(rows, topics(spark)).collect()) == [1, 1, 2]


def test_attempts(spark):
    rows = spark.createDataFrame([("a", 0, 0, 10), ("a", 1, 4, 20), ("a", 2, 9, 40), ("b", 0, 0, 1), ("b", 1, 0, 1), ("b", 2, 0, 1), ("b", 3, 5, 1)], "k string, attempt long, n long, tokens long")
    got = {r["k"]: tuple(r)[1:] for r in selection.first_success(rows, "k", "attempt", "n", "tokens", 3).collect()}
    assert got == {"a": (1, 4, 30), "b": (None, 0, 3)}


def test_ticks_and_progress(spark):
    assert values(spark, lifecycle.ticked(F.lit(0), F.lit(5), F.lit(20))) == 4
    assert values(spark, lifecycle.ticked(F.lit(0), F.lit(1), F.lit(20))) == 0
    assert values(spark, lifecycle.progress(F.lit(1), F.lit(0), F.lit(3))) == 0.33
    assert values(spark, lifecycle.progress(F.lit(1), F.lit(0), F.lit(0))) is None


@pytest.mark.parametrize("status,done,total,percent", [("processing", 10, 20, 50), ("processing", 19, 20, 95), ("ready", 0, 0, 100), ("processing", 1, 0, 0), ("generating", 5, 5, 95), ("completed", 5, 5, 100), ("failed", 3, 5, 0), ("partial", 1, 8, 13)])
def test_screen_progress(spark, status, done, total, percent):
    assert values(spark, lifecycle.screen_progress(F.lit(status), F.lit(done), F.lit(total))) == percent


def test_latest_keeps_the_first_end(spark):
    log = spark.createDataFrame([(1, 1, 1, "generating"), (1, 2, 2, "failed"), (1, 3, 3, "completed"), (2, 1, 4, "pending"), (2, 2, 5, "generating")], "k int, at int, id int, status string")
    assert sorted(tuple(r) for r in lifecycle.latest(log, "k", "at", "id", "status").select("k", "id").collect()) == [(1, 2), (2, 5)]


def test_rate_window_leaves_out_the_edge(spark):
    rows = spark.createDataFrame([(1, 0), (1, 60), (1, 61)], "k int, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["requests"] for r in lifecycle.rate_limited(rows, ["k"], "ts", F.lit(1)).orderBy("s").collect()] == [1, 1, 2]


@pytest.mark.parametrize("split", [False, True])
def test_rate_windows_are_those_of_a_loop(spark, split):
    draw = random.Random(4)
    calls = [(i, draw.choice("ab"), None if i % 50 == 0 else draw.randrange(600), None if draw.random() < 0.5 else draw.randrange(40)) for i in range(400)] + [(400, None, 5, 3), (401, "lone", 9, None)]
    frame = spark.createDataFrame(calls, "id int, k string, s int, at_ int").withColumn("ts", F.timestamp_seconds("s"))
    limits = config.Config(rate_requests=20, rate_tokens=300, rate_window_s=60)

    def told(k, s):
        seen = [t for _, k2, s2, t in calls if k2 == k and (s2 is None if s is None else s2 is not None and s - 60 < s2 <= s)]
        known = [t for t in seen if t is not None]
        return len(seen), sum(known) if known else None

    out = lifecycle.rate_limited(frame, ["k"], "ts", F.col("at_"), limits, split)
    got = {r["id"]: (r["requests"], r["tokens"]) for r in out.collect()}
    assert got == {i: told(k, s) for i, k, s, _ in calls} and out.columns == [*frame.columns, "requests", "tokens", "allowed"]
    assert all(r["allowed"] == (None if r["tokens"] is None and r["requests"] <= 20 else r["requests"] <= 20 and r["tokens"] <= 300) for r in out.collect())


def test_rate_windows_read_a_row_once(spark):
    rows = spark.range(10).select(F.lit("a").alias("k"), F.timestamp_seconds("id").alias("ts"))
    for split in (False, True):  # a frame that slides would read a window's rows for each of them
        plan = lifecycle.rate_limited(rows, ["k"], "ts", F.lit(1), split=split)._jdf.queryExecution().executedPlan().toString()
        assert "unboundedpreceding" in plan and "-59999999" not in plan


def test_serving(spark):
    rows = spark.createDataFrame([(i, "u") for i in range(30)], "id long, owner string")
    assert serving.page(rows, [F.desc("id")]).count() == 20 and serving.page(rows, [F.desc("id")], 1000, -5).count() == 30
    assert serving.cache_misses(rows, rows.where("id < 29"), "id").count() == 1
    kids = spark.createDataFrame([(0, 1), (0, 3)], "id long, o int")
    got = {r["id"]: r for r in serving.may_add(rows.where("id < 2"), kids, "id", "o", F.lit(3)).collect()}
    assert (got[0]["next_order"], got[0]["collides"], got[0]["allowed"]) == (3, True, True) and got[1]["n"] == 0


def test_exports(spark, tmp_path):
    q = spark.createDataFrame([(1, 2, "two?", GOOD, "B", "why 2", "easy", "t", "v", 0.5), (1, 1, "one?", GOOD, "A", "why 1", "easy", "t", "v", None)], "test int, sort_order long, question string, options map<string,string>, correct_option string, explanation string, difficulty string, topic_tag string, validation_result string, quality_score double")
    lines = [r["line"] for r in export.paper_lines(q, "test").orderBy("section", "ord").collect()]
    assert lines[:2] == ["Q1. one?", "  A. a"] and lines[-1] == "Q2. why 2" and len(lines) == 14
    made = json.loads(export.as_json(q, "test").first()["json"])
    assert made["questions_generated"] == 2 and [m["question"] for m in made["mcqs"]] == ["one?", "two?"]
    path = str(tmp_path / "questions")
    export.replace_questions(q.unionByName(q.withColumn("test", F.lit(2))), "test", path)
    export.replace_questions(q.where("sort_order = 2"), "test", path)
    assert sorted((r["test"], r["sort_order"]) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 1), (2, 2)]


@pytest.mark.parametrize("pages,calls", [(10, [10]), (14, [14]), (15, [14, 1]), (30, [14, 14, 2]), (0, [])])
def test_page_ranges(spark, pages, calls):
    assert [r["last"] - r["first"] + 1 for r in values(spark, files.page_ranges(F.lit(pages)))] == calls


def test_page_texts_and_papers(spark):
    pages = spark.createDataFrame([(1, p, f"page {p}".encode()) for p in range(30)] + [(2, 0, b"")], "k int, page int, content binary")
    assert {r["k"]: r["text"] for r in files.page_texts(pages, "k").collect()} == {1: "\n".join(f"page {p}" for p in range(30))}
    papers = spark.createDataFrame([(1, 1, " b "), (1, 0, "a"), (1, 2, " ")], "k int, page int, text string")
    assert files.paper_text(papers, "k").first()["text"] == "a\n\nb"


def test_extraction_results(spark):
    def run(text, pages, found=True, error=None):
        return values(spark, files.extraction(F.col("t").cast("string"), F.col("p").cast("int"), F.lit(found), F.col("e").cast("string")), t=text, p=pages, e=error)

    good = run("This is extracted text from Document AI. " * 20, 2)
    assert good["is_valid"] and good["page_count"] == 2 and len(good["text"]) == 819
    assert run("Too short", 1)["error_message"] == "Extracted text too short or empty"
    assert "Document AI" in run("x", 1, error="boom")["error_message"]
    missing = run(None, None, found=False)
    assert "not found" in missing["error_message"] and missing["page_count"] == 0


def test_pdf_source(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(pdf(2))
    (tmp_path / "b.pdf").write_bytes(b"junk")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r["path"][-5:]: r["pages"] for r in files.page_counts(files.pdf_files(spark, str(tmp_path))).select("path", "pages").collect()}
    assert got == {"a.PDF": 2, "b.pdf": None}


def test_styles_and_outlines(spark):
    papers = spark.createDataFrame([("What is the meaning of this question?",)] * 2 + [("x",)], "text string")
    first = style.style_profiles(papers)
    rows = first.collect()
    assert len(rows) == 2 and sorted(r["profile"] is None for r in rows) == [False, True]
    assert style.style_profiles(papers, first).count() == 0
    chunks = spark.createDataFrame([(1, 12, i, f"text of chunk {i}") for i in range(12)] + [(2, 9, 0, "few")], "k int, n_chunks int, chunk_ix int, text string")
    got = style.outlines(chunks, "k").collect()
    assert len(got) == 1 and got[0]["outline"].split("\n")[9] == "Chunk 10: text of chunk 9" and len(got[0]["outline"].split("\n")) == 10


def test_registered_providers_run_on_workers_and_failed_batches_go_one_by_one(spark):
    class Here(providers.MockProvider):
        def summarize(self, texts):
            if len(texts) > 1 or texts == ["bad"]:
                raise RuntimeError
            return [t.upper() for t in texts]

        def validate(self, questions):
            if len(questions) > 1 or "bad" in questions[0]:
                raise RuntimeError
            return [{"is_valid": True, "quality_score": 0.9, "critique": questions[0]}]

    providers.register("fragile", Here)
    rows = spark.createDataFrame([("a",), ("bad",), (None,), ("c",)], "t string").coalesce(1)
    assert [r["o"] for r in providers.mapped(rows, "t", "o", "summarize", "fragile").collect()] == ["A", None, None, "C"]
    verdicts = [tuple(r["v"]) for r in providers.mapped(rows, "t", "v", "validate", "fragile").collect()]
    assert verdicts == [(True, 0.9, "a"), (False, 0.5, ""), (False, 0.5, ""), (True, 0.9, "c")]
    assert isinstance(providers.provider("missing"), providers.MockProvider)
    with pytest.raises(ValueError):
        providers.mapped(rows, "t", "o", "summarize", "missing")


def test_short_answers_are_padded_and_slow_ones_given_up(spark):
    class Short(providers.MockProvider):
        def validate(self, questions):
            return [{"is_valid": True, "quality_score": 1.0, "critique": "x"}]

        def summarize(self, texts):
            import time

            time.sleep(5 if texts == ["slow"] else 0)
            return texts

    providers.register("short", Short)
    rows = spark.createDataFrame([("a",), ("slow",), ("c",)], "t string").coalesce(1)
    assert [tuple(r["v"]) for r in providers.mapped(rows, "t", "v", "validate", "short").collect()] == [(True, 1.0, "x"), (False, 0.5, ""), (False, 0.5, "")]
    assert [r["o"] for r in providers.mapped(rows, "t", "o", "summarize", "short", 1, limit_s=1.0).collect()] == ["a", None, "c"]


def test_generation_asks_again_until_there_are_questions(spark):
    class Late(providers.MockProvider):
        def __init__(self):
            self.asked = {}

        def generate(self, texts, n, slugs, level=None, style=None):
            out = []
            for t in texts:
                self.asked[t] = self.asked.get(t, 0) + 1
                made = providers.MockProvider().generate([t], n, slugs, level, style)[0]
                out.append("```json\n" + made + "\n```" if self.asked[t] >= {"one": 1, "three": 3}.get(t, 9) else "sorry")
            return out

    providers.register("late", Late)
    rows = spark.createDataFrame([("one",), ("three",), ("never",)], "t string").coalesce(1)
    got = {r["t"]: (providers.some_questions(r["raw"]), r["attempts"]) for r in providers.asked_until(rows, "t", (2, ["polity"]), "late").collect()}
    assert got == {"one": (True, 1), "three": (True, 3), "never": (False, 3)}


def test_generated_by_a_registered_provider(spark, sf):
    from dataclasses import replace

    from quizmill.plans.generate import generated

    class Strict(providers.MockProvider):
        def validate(self, questions):
            return [{"is_valid": "Question 1 " in q, "quality_score": 0.9, "critique": "fine" if "Question 1 " in q else "incorrect key"} for q in questions]

        def summarize(self, texts):
            return ["head"] * len(texts)

        def generate(self, texts, n, slugs, level=None, style=None):
            found = super().generate(texts, n, slugs, level, style)
            return [f.replace("main idea", "outline" if t.startswith("Document outline:\nChunk 1: head") else "main idea") for f, t in zip(found, texts)]

    providers.register("strict", Strict)
    rows = generated(spark, sf, name="strict", level="Hard").collect()
    assert rows and all(r["question"].startswith("[Mock] Question 1 ") and r["quality_score"] == 0.9 and r["difficulty"] == "hard" for r in rows)
    long = generated(spark, sf, config=replace(config.DEFAULT, use_global_outline=True), name="strict").collect()
    assert len(long) == len(rows) and 0 < sum("outline" in r["question"] for r in long) < len(long)


def test_chains_on_workers_and_refusals(spark):
    class Down(providers.MockProvider):
        def summarize(self, texts):
            raise RuntimeError("model not found (404)")

    class Prim(providers.MockProvider):
        def __init__(self, guarded=True):
            self.guarded = guarded

        def unguarded(self):
            return type(self)(False)

        def summarize(self, texts):
            if self.guarded:
                raise RuntimeError("blocked for safety")
            return [f"plain {t}" for t in texts]

    class Slow(providers.MockProvider):
        def summarize(self, texts):
            import time

            time.sleep(3)
            return texts

    providers.register("down", Down)
    providers.register("prim", Prim)
    providers.register("slow", Slow)
    rows = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    assert [r["o"] for r in providers.mapped(rows, "t", "o", "summarize", ("down", "prim")).collect()] == ["plain a", "plain b"]
    with pytest.raises(TimeoutError):
        providers.Chain("slow", "mock", limit_s=0.2).summarize(["x"])


def test_styles_are_given_up_after_a_time(spark):
    class Sleepy(providers.MockProvider):
        def summarize(self, texts):
            import time

            time.sleep(4)
            return texts

    providers.register("sleepy", Sleepy)
    papers = spark.createDataFrame([("What is the meaning of this question?",)], "text string")
    assert [r["profile"] for r in style.style_profiles(papers, name="sleepy", limit_s=0.5).collect()] == [None]


def pdf(pages, compressed=False):
    """A PDF with a two-level tree of pages, its dictionaries in an object stream if compressed."""
    import zlib

    half = pages // 2
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [3 0 R 4 0 R] /Count %d>>" % pages}
    numbers = list(range(10, 10 + pages))
    for k, part in ((3, numbers[:half]), (4, numbers[half:])):
        objects[k] = b"<</Type/Pages/Parent 2 0 R/Count %d/Kids[%s]>>" % (len(part), b" ".join(b"%d 0 R" % n for n in part))
    for n in numbers:
        objects[n] = b"<</Type/Page/Parent 3 0 R/MediaBox[0 0 9 9]/Mark(page %d)>>" % (n - 10)
    if not compressed:
        return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer<</Root 1 0 R>>\nstartxref\n9\n%%EOF\n"
    heads, body = [], b""
    for n, x in objects.items():
        heads.append(b"%d %d" % (n, len(body)))
        body += x + b" "
    first = b" ".join(heads) + b" "
    packed = zlib.compress(first + body)
    return b"%%PDF-1.5\n99 0 obj\n<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>stream\n%s\nendstream\nendobj\nstartxref\n0\n%%%%EOF\n" % (len(objects), len(first), len(packed), packed)


@pytest.mark.parametrize("compressed", [False, True])
def test_pdf_pages_are_counted_and_split(spark, compressed):
    from pyspark.sql import Row

    class Reader(providers.MockProvider):
        def ocr(self, parts):
            out = []
            for p in parts:
                numbers, objects = files.pdf_pages(p), files.pdf_objects(p)
                out.append(" ".join(objects[n].decode().split("(page ")[1].split(")")[0] for n in numbers))
            return out

    providers.register("reader", Reader)
    made = {"long": pdf(30, compressed), "short": pdf(14, compressed), "junk": b"junk", "none": None, "broken": b"%PDF-1.4 nothing"}
    rows = spark.createDataFrame([Row(k=k, content=bytearray(v) if v is not None else None) for k, v in made.items()], "k string, content binary")
    counts = {r["k"]: r["pages"] for r in files.page_counts(rows).collect()}
    assert counts == {"long": 30, "short": 14, "junk": None, "none": None, "broken": None}
    got = {r["k"]: r["text"] for r in files.ocr_texts(rows, "k", "reader").collect()}
    assert got["long"] == "\n".join(" ".join(map(str, range(30)[a : a + 14])) for a in (0, 14, 28)) and got["short"] == " ".join(map(str, range(14)))
    assert got["junk"] is got["none"] is None


def scanned_pdf(pages, size, encrypted=False):
    """A PDF whose pages have images of size bytes each, a shared font, resources on their tree, and a link to the first page."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count %d/MediaBox[0 0 5 [6]]/Resources<</Font<</F 3 0 R>>>>/Kids[%s]>>" % (pages, b" ".join(b"%d 0 R" % (10 + 3 * n) for n in range(pages))), 3: b"<</Type/Font/Name/Shared>>"}
    for n in range(pages):
        image = (b"endobj 7 0 obj %d " % n).ljust(size, b"x")
        objects[10 + 3 * n] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R/Annots[%d 0 R]/Mark(page %d)>>" % (11 + 3 * n, 12 + 3 * n, n)
        objects[11 + 3 * n] = b"<</Length %d>>\nstream\n%s\nendstream" % (len(image), image)
        objects[12 + 3 * n] = b"<</Type/Annot/Dest[10 0 R/Fit]>>"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer<</Root 1 0 R%s>>\nstartxref\n9\n%%%%EOF\n" % (b"/Encrypt 3 0 R" if encrypted else b"")


def test_a_part_is_as_large_as_its_pages():
    whole = scanned_pdf(40, 20_000)
    order = files.pdf_pages(whole)
    part = files.pdf_part(whole, order[14:28])
    assert len(order) == 40 and 14 * 20_000 < len(part) < 14 * 20_600 < len(whole) / 2
    held = files.pdf_streams(part)
    assert files.pdf_pages(part) == order[14:28]
    for n, number in zip(range(14, 28), order[14:28], strict=True):
        head = held[number][0]
        assert b"(page %d)" % n in head and b"/MediaBox [0 0 5 [6]]" in head and b"/Font<</F 3 0 R>>" in head
        assert held[number + 1][1].startswith(b"endobj 7 0 obj %d " % n) and len(held[number + 1][1].rstrip()) == 20_000
    assert held[3][0].strip() == b"<</Type/Font/Name/Shared>>" and 10 not in held and 2 not in held and 7 not in held
    # every object is where the table says
    table = int(part.split(b"startxref\n")[1].split()[0])
    assert part[table:].startswith(b"xref")
    places = part[table:].split(b"trailer")[0].split(b"\n")[3:]
    for at, place in zip(places[::2], places[1::2], strict=False):
        assert part[int(place[:10]) :].startswith(b"%d 0 obj" % int(at.split()[0]))
    # all of it again, from its own part
    assert files.pdf_pages(files.pdf_part(part, order[20:22])) == order[20:22]
    locked = scanned_pdf(40, 2000, True)
    assert files.pdf_pages(files.pdf_part(locked, order[:3])) == order[:3] and files.pdf_part(locked, order[:3]).startswith(locked)


def test_parts_of_a_file_go_to_several_tasks(spark):
    from pyspark import TaskContext

    class Where(providers.MockProvider):
        def ocr(self, parts):
            if b"(page 60)" in parts[0]:
                raise RuntimeError("too dark")
            return [f"task {TaskContext.get().partitionId()}"]

    providers.register("where", Where)
    made = [("a", scanned_pdf(56, 50)), ("a", scanned_pdf(56, 50)), ("b", scanned_pdf(70, 50)), ("a", scanned_pdf(2, 50)), (None, b"junk")]
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in made], "k string, content binary")
    assert rows.count() == 5 and files.ocr_calls(rows, "k").where("k = 'b'").count() == 5
    got = sorted(((r["k"], r["pages"], r["text"], r["error"]) for r in files.ocr_texts(rows, "k", "where").collect()), key=str)
    assert [(k, n, e) for k, n, _, e in got] == [("a", 2, None), ("a", 56, None), ("b", 70, "too dark"), (None, None, None)]
    assert len(got[1][2].split("\n")) == 4 and len(set(got[1][2].split("\n"))) > 1 and got[2][2] is None


def test_late_calls_share_a_thread_and_are_counted():
    import threading

    open_ = threading.Event()
    limited = providers.Limited(0.2, most_abandoned=2)
    names = {limited(lambda: threading.current_thread().name) for _ in range(5)}
    assert len(names) == 1
    for _ in range(2):
        with pytest.raises(TimeoutError):
            limited(open_.wait, 20)
    with pytest.raises(TimeoutError, match="2 calls"):
        limited(lambda: 1)
    open_.set()
    import time

    time.sleep(0.3)
    assert limited(lambda: 7) == 7 and limited.abandoned == 2
    limited.close()
    with pytest.raises(ValueError, match="own"):
        limited(int, "own")


def test_ocr_failures_are_told(spark):
    class Broken(providers.MockProvider):
        def ocr(self, parts):
            raise RuntimeError("x" * 900)

    providers.register("broken_ocr", Broken)
    rows = spark.createDataFrame([("a", bytearray(pdf(2)))], "k string, content binary")
    found = files.ocr_texts(rows, "k", "broken_ocr").first()
    assert found["text"] is None and found["error"] == "x" * 512


def test_located(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(2))
    listing = files.pdf_files(spark, str(tmp_path))
    asked = spark.createDataFrame([("a.pdf",), (f"{tmp_path}/a.pdf",), ("b.pdf",), ("/no/a.pdf",), (None,)], "path string")
    got = {r["path"]: r["located"] for r in files.located(asked, listing, str(tmp_path)).collect()}
    full = f"{tmp_path}/a.pdf"
    assert got == {"a.pdf": full, full: full, "b.pdf": None, "/no/a.pdf": None, None: None}


def test_seen_runs_retry_review_and_end(spark):
    class Eye(providers.MockProvider):
        calls = 0

        def see(self, images, n):
            type(self).calls += 1
            if images[0] == b"odd" and type(self).calls % 2:
                return "nothing", 10
            return super().see(images, n)[0], 60

        def review(self, raw):
            return raw.replace("[Mock]", "[Read]"), 5

    providers.register("eye", Eye)
    rows = [(k, p, b"odd" if (k, p) == (1, 0) else b"page") for k in (1, 2) for p in range(8)]
    images = spark.createDataFrame(rows, "k long, page int, content binary").coalesce(1)
    free = lambda: pages.Throttle(10**9, 60)
    got = sorted((r["k"], r["batch"], "[Read]" in r["raw"], r["tokens"]) for r in pages.seen_run(images, "k", 2, "eye", throttle=free).collect())
    assert got == [(1, 0, True, 75), (1, 1, True, 65), (1, 2, True, 65), (2, 0, True, 65), (2, 1, True, 65), (2, 2, True, 65)]
    ended = sorted((r["k"], r["batch"]) for r in pages.seen_run(images, "k", 2, "eye", limit=100, throttle=free).collect())
    assert ended == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_throttle_waits_for_room():
    now, slept = [0.0], []
    t = pages.Throttle(100, 60, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        t.wait()
        t.add(60)
        now[0] += 1
    assert slept == [58.0]


def test_at_most_three_jobs_run(spark):
    import threading
    import time

    from quizmill.operators.running import Jobs

    lock, now, most = threading.Lock(), [0], [0]

    def work(k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.3)
        with lock:
            now[0] -= 1
        return spark.range(k).count()

    jobs = Jobs(spark)
    found = [jobs.enqueue(f"job{k}", lambda k=k: work(k)) for k in range(8)]
    assert jobs.enqueue("job7", lambda: 1) is found[7]
    assert [f.result(60) for f in found] == list(range(8)) and most[0] == 3
    with pytest.raises(ZeroDivisionError):
        jobs.enqueue("bad", lambda: 1 // 0).result(60)
    jobs.close()


def test_exports_are_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, '{"a": 1}'), (2, "{}")], "test_id long, json string")
    export.write_exports(docs, "test_id", str(tmp_path / "exports"))
    export.write_exports(docs.where("test_id = 1"), "test_id", str(tmp_path / "exports"))
    got = {d.name: "".join(f.read_text() for f in d.glob("part-*")) for d in (tmp_path / "exports").glob("test_id=*")}
    assert got == {"test_id=1": '{"a": 1}\n', "test_id=2": "{}\n"}


def test_embeddings_are_deterministic(spark):
    rows = spark.createDataFrame([("polity and constitution",), ("polity and constitution",)], "t string")
    a, b = (r["embedding"] for r in providers.embedded(rows, "t").collect())
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-5


def test_schemas(spark):
    for name in schemas.TABLES:
        assert len(schemas.schema(name)) > 4
    old = spark.createDataFrame([(1,)], "id int")
    new = spark.createDataFrame([(2, "x")], "id int, added string")
    assert sorted(map(tuple, schemas.evolved(old, new).collect()), key=str) == [(1, None), (2, "x")]
    assert config.DEFAULT.chunk_size == 1500


@pytest.mark.parametrize(
    "status,done,total,target,age,message",
    [
        ("generating", 2, 5, 5, 10, "Generating... usually under 1 minute. 2 of 5 questions created"),
        ("pending", None, 0, 5, 700, "Generating... usually under 1 minute. 0 of 5 questions created (this may take a while for large documents)"),
        ("completed", 5, 5, 5, 9999, "5 of 5 questions created"),
        ("failed", 0, 0, 0, 1, "failed"),
    ],
)
def test_status_messages(spark, status, done, total, target, age, message):
    got = values(spark, lifecycle.status_message(F.lit(status), F.lit(done).cast("int"), F.lit(total), F.lit(target), F.lit(age), F.lit(1200)))
    assert got == message


def test_screen_text(spark):
    from quizmill.functions import text

    assert values(spark, text.screen_word_count(F.lit("a b  c"))) == 3
    assert values(spark, text.screen_word_count(F.repeat(F.lit("x"), F.lit(400_003)))) == 80_001
    assert values(spark, text.screen_text(F.repeat(F.lit("x"), F.lit(60_001)))) is None


def test_chains_retry_and_stay_with_the_next():
    calls = []

    class Busy(providers.MockProvider):
        def summarize(self, texts):
            calls.append("busy")
            raise RuntimeError("HTTP 429")

    class Broken(providers.MockProvider):
        def summarize(self, texts):
            calls.append("broken")
            raise ValueError("bad request")

    providers.register("busy", Busy)
    providers.register("broken", Broken)
    chain = providers.Chain("busy", "broken", "mock", tries=3, wait=lambda _: None)
    assert chain.summarize(["a b"]) == ["a b"] and calls == ["busy"] * 3 + ["broken"]
    assert chain.summarize(["c"]) == ["c"] and len(calls) == 4
    with pytest.raises(RuntimeError):
        providers.Chain("broken", wait=lambda _: None).summarize([])
