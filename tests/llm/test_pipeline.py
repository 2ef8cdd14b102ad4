import re

import corpus_pipeline
import pytest
from test_decontam import brute as contaminated
from test_packing import check as check_packing
from test_pii import BASE, KINDS, fine
from test_simhash import jaccard_groups

from quizmill.llm.quality import score_quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage gets and gives."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        found.append((name, docs, out, rows))
        docs = spark.createDataFrame(rows, out.schema)
    return found


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert all(out.columns == docs.columns for _, docs, out, _ in stages[:-1])


def test_quality_drops_the_rejected_only(spark, sf, stages):
    _, docs, _, rows = stages[0]
    scores = score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in scores if r["predicted"] == 1)
    assert 0 < len(rows) < len(scores)


def test_one_of_each_group_stays(stages):
    _, docs, _, rows = stages[1]
    assert sorted(r["doc_id"] for r in rows) == jaccard_groups(pairs(docs))


def test_contaminated_documents_go(spark, sf, stages):
    _, docs, _, rows = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in contaminated(pairs(docs), items) if not r[5]}
    assert {r["doc_id"] for r in rows} == clean and len(clean) < len(pairs(docs))


def masked(text):
    spans = sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(BASE[kind], text) if fine(kind, m[0]))
    at, out = 0, ""
    for a, k, b in spans:
        if a >= at:
            out += text[at:a] + f"<{KINDS[k].upper()}>"
        at = max(at, b)
    return out + text[at:]


def test_personal_data_is_masked(stages):
    _, docs, _, rows = stages[3]
    before = dict(pairs(docs))
    assert sorted(before) == sorted(r["doc_id"] for r in rows)
    assert all(r["text"] == masked(before[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in rows)


def test_what_is_left_is_packed(stages):
    _, docs, _, rows = stages[4]
    check_packing(rows, pairs(docs))


def test_run_gives_the_same(spark, sf, stages):
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, stages[-1][3]))


def test_empty_and_null_rows_pass_every_stage(spark, sf):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (1, None, None, None, None)], DOCS)
    score = {r["score"] for r in score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert len(score) == 1  # all three texts count as empty
    left = {"quality": docs.count() if score.pop() >= 0.3 else 0, "near_duplicates": 1, "decontamination": 3, "personal_data": 3}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name == "packing":  # each text is a piece of its end mark
            assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"]) for r in rows) == [("1", 0, 0, 1), ("1", 0, 0, 1), ("None", 0, 0, 1)]
        else:
            assert len(rows) == left[name] and out.columns == docs.columns
            assert all((r["doc_id"], r["text"]) in {(1, None), (None, "")} for r in rows)
        if name != "packing":
            assert stage(spark, docs.limit(0), sf).collect() == []


def test_odd_rows_pass_every_stage(spark, sf):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names the stages use themselves."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = [r["text"] for r in corpus_pipeline.quality(spark, docs, sf).orderBy("doc_id").limit(3).collect()]
    long = " ".join(good) * 40 + " mail a.b@c.example now"
    rows = [(1, good[0]), (1, good[0]), (2, good[1]), (None, good[2]), (None, None), (3, None), (4, ""), (5, long), (6, long)]
    odd = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)
    odd = odd.withColumn("row", F.lit("r")).withColumn("kept", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("mark_", F.lit(2)).withColumn("a.b", F.lit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns
        found = out.collect()
        assert {(r["row"], r["kept"], r["spans"], r["mark_"], r["a.b"]) for r in found} == {("r", 1, "x", 2, 3)}
        ids = sorted(str(r["doc_id"]) for r in found)
        if name == "near_duplicates":
            assert sorted(ids) == ["1", "2", "3", "5", "None"] and next(len(r["text"]) for r in found if r["doc_id"] == 5) == len(long)
        elif name == "decontamination":
            gone = {r[0] for r in contaminated([(k, t) for k, (_, t) in enumerate(rows)], [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]) if r[5]}
            assert ids == sorted(str(d) for k, (d, _) in enumerate(rows) if k not in gone)
        elif name == "personal_data":
            assert len(found) == len(rows) and sorted(str(r["text"]) for r in found) == sorted(str(t and masked(t)) for _, t in rows)
    packed = corpus_pipeline.packing(spark, odd, sf).collect()
    check_packing(packed, rows)
