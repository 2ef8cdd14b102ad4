"""Operators that spread one key, text or set of queries over many tasks."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import values
from pyspark.sql import functions as F

from quizmill import providers
from quizmill.config import DEFAULT, Config
from quizmill.functions.text import clean
from quizmill.operators import nearest
from quizmill.operators.admission import admitted
from quizmill.operators.lifecycle import latest
from quizmill.operators.lines import paragraph_lines
from quizmill.operators import serving
from quizmill.operators.nearest import best_places, nearest_of_each, relevant_sample
from quizmill.operators.paging import PageIndex
from quizmill.operators.retrieval import spread
from quizmill.operators.scan import scanned
from quizmill.plans.generate import generated
from quizmill.streaming.merged import MergedTable, ReplacedTable

START = datetime(2024, 1, 1)


def test_scans_are_those_of_whole_keys(spark):
    draw = random.Random(1)
    rows = [(k, i, draw.randrange(-50, 50)) for k in range(3) for i in range(200 if k else 900)]
    frame = spark.createDataFrame(rows, "k int, i int, v long").withColumn("piece", F.floor(F.col("i") / 37)).repartition(5)
    for fold, join, plain in ((F.sum, lambda a, b: a + b, sum), (F.max, F.greatest, max)):
        got = {(r["k"], r["i"]): r["out"] for r in scanned(frame, ["k"], "piece", ["i"], F.col("v"), "out", fold, join).collect()}
        by = {k: [v for x, _, v in rows if x == k] for k in range(3)}
        assert got == {(k, i): plain(by[k][: i + 1]) for k, i, _ in rows}


def plain_starts(calls, limit, window):
    """Starts by a loop over each key's calls."""
    out, seen = {}, {}
    for i, key, at in sorted((c for c in calls if c[1] is not None and c[2] is not None), key=lambda c: (c[2], c[0])):
        mine = seen.setdefault(key, [])
        mine.append(max(at, mine[-limit] + timedelta(seconds=window)) if len(mine) >= limit else at)
        out[i] = mine[-1]
    return out


@pytest.mark.parametrize("limit,window,piece", [(30, 60, 10), (1, 7, 3600), (3, 100, 33)])
def test_admission_is_that_of_a_loop(spark, limit, window, piece):
    draw = random.Random(limit)
    calls = [(i, "hot" if draw.random() < 0.6 else f"u{draw.randrange(4)}", START + timedelta(seconds=draw.randrange(900), microseconds=draw.choice([0, 1, 999_999]))) for i in range(700)]
    calls += [(1000, None, START), (1001, "u1", None), (1002, "lone", START)]
    frame = spark.createDataFrame([(*c, "x", 5) for c in calls], "id long, who string, ts timestamp, start_at string, rank_ int").withColumnRenamed("start_at", "value_").repartition(6)
    out = admitted(frame, "who", "ts", "id", Config(rate_requests=limit, rate_window_s=window), piece).collect()
    expected = plain_starts(calls, limit, window)
    assert len(out) == len(calls) and {r["id"]: r["start_at"] for r in out} == {i: expected.get(i) for i, _, _ in calls}
    assert all(r["wait_us"] == (r["start_at"] - r["ts"]) / timedelta(microseconds=1) for r in out if r["start_at"]) and {r["value_"] for r in out} == {"x"}
    # never more than the limit in a window
    hot = sorted(r["start_at"] for r in out if r["who"] == "hot")
    assert all(b - a >= timedelta(seconds=window) for a, b in zip(hot, hot[limit:], strict=False))
    assert admitted(frame.limit(0), "who", "ts", "id").collect() == []


def plain_nearest(queries, vectors, k, itself):
    ok = lambda v: v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)
    out = []
    for q, a in queries:
        if q is None or not ok(a):
            continue
        scored = [(-round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-12)), 9), i) for i, b in vectors if i is not None and ok(b) and (itself or i != q)]
        out += [(q, i, n) for n, (_, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("tile,tiles", [(1024, 16), (3, 16), (3, 0)])
def test_nearest_is_exact_in_any_tiling(spark, monkeypatch, tile, tiles):
    monkeypatch.setattr(nearest, "TILE", tile)
    monkeypatch.setattr(nearest, "TILES", tiles)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(200)]  # many ties
    vectors += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [1.0]), (None, [1.0] * 4), (204, [0.0] * 4)]
    queries = [(i, v) for i, v in vectors if i is None or i % 20 == 0 or i > 199]
    a = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    b = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, tile string").repartition(5)
    for itself in (True, False):
        got = nearest_of_each(a, b, 7, itself=itself).collect()
        assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in got) == plain_nearest(queries, vectors, 7, itself)
    assert nearest_of_each(a.limit(0), b, 7).collect() == [] and nearest_of_each(a, b.limit(0), 7).collect() == []
    assert nearest_of_each(a.where("query_id = 20"), b.where("vec_id < 3"), 7).count() == 3


def test_nearest_multiplies_few_vectors_at_once(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 7)
    real, rng = nearest.best_places, np.random.default_rng(4)

    def narrow(sims, ids, k):
        assert sims.shape[1] <= 7
        return real(sims, ids, k)

    monkeypatch.setattr(nearest, "best_places", narrow)
    vectors = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(90)]
    b = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1)
    got = nearest_of_each(b.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), b, 9, itself=False).collect()
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in got) == plain_nearest([v for v in vectors if v[0] % 20 == 0], vectors, 9, False)


def test_best_places_break_ties_by_id():
    row, column = best_places(np.array([[1.0, 1.0, 1.0, 0.5], [0.1, 0.2, 0.3, 0.3]]), np.array([9, 4, 7, 1]), 2)
    assert row.tolist() == [0, 0, 1, 1] and column.tolist() == [1, 2, 3, 2]


def test_relevant_sample(spark):
    parts = [(d, 8, i, f"{'polity law' if (i + d) % 3 == 0 else 'rivers and hills'} {i}") for d in (1, 2, 3) for i in range(8)] + [(4, 2, 0, "short"), (4, 2, 1, "doc")]
    chunks = spark.createDataFrame(parts, "doc_id long, n_chunks long, chunk_ix int, text string")
    asked = spark.createDataFrame([(1, "polity law"), (2, "rivers and hills"), (3, None), (4, "x")], "doc_id long, goal string")
    got = sorted((r["doc_id"], r["chunk_ix"]) for r in relevant_sample(chunks, asked, "doc_id", "goal", 3).collect())
    mock = providers.MockProvider()

    def best(d, goal):
        g = mock.embed([goal])[0].astype(float)
        sims = [(-round(float(v @ g / (np.linalg.norm(v) * np.linalg.norm(g) + 1e-12)), 9), i) for i, v in enumerate(mock.embed([t for x, _, _, t in parts if x == d]).astype(float))]
        return sorted(i for _, i in sorted(sims)[:3])

    at = values(spark, spread(F.lit(8), 3))
    assert got == [(1, i) for i in best(1, "polity law")] + [(2, i) for i in best(2, "rivers and hills")] + [(3, i) for i in at] + [(4, 0), (4, 1)]


def test_generation_takes_relevant_chunks(spark, sf):
    spread_out = generated(spark, sf, 2).collect()
    relevant = generated(spark, sf, 2, goal=lambda d: F.lit("history of rivers")).collect()
    assert {r["doc_id"] for r in relevant} == {r["doc_id"] for r in spread_out} and {r["question"] for r in relevant} != {r["question"] for r in spread_out}


ROWS = [(k % 7, i, START + timedelta(seconds=(i * 37) % 500), "completed" if i % 31 == 0 else "failed" if i % 29 == 0 else "generating") for i, k in enumerate(random.Random(2).choices(range(40), k=400))]
SCHEMA = "k long, id long, ts timestamp, status string"


def merged(spark, path, buckets=4):
    return MergedTable(spark, str(path), SCHEMA, "k", "ts", "id", "status", buckets)


def rows_of(frame):
    return sorted(map(tuple, frame.select("k", "id", "ts", "status").collect()))


def test_merges_in_any_cut_give_the_batch_result(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    expected = rows_of(latest(frame, "k", "ts", "id", "status"))
    for cut in (1, 3, 50):
        held = merged(spark, tmp_path / f"t{cut}")
        assert held.read().collect() == [] and held.folders() == (-1, {})
        for n in range(cut):
            assert held.merge(frame.where(F.col("id") % cut == n) if cut < 50 else frame.where((F.col("id") % 3 == n) & (n < 3)), n)
            if n == 4:
                break
        assert rows_of(held.read()) == expected


def test_batches_come_once_and_failures_leave_nothing(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([*ROWS, (None, 999, START, "failed")], SCHEMA)
    held = merged(spark, tmp_path / "t")
    assert held.merge(frame.where("id < 200"), 0, "s") and not held.merge(frame.where("id >= 200"), 0, "s")
    before = rows_of(held.read())
    # rows are written, but the merge ends before it is in the log
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        held.merge(frame.where("id >= 200"), 1, "s")
    monkeypatch.undo()
    assert rows_of(merged(spark, tmp_path / "t").read()) == before
    assert held.merge(frame.where("id >= 200"), 1, "s") and held.merge(frame.limit(0), 2, "s") and held.merge(frame, 0, "other")
    assert rows_of(held.read()) == rows_of(latest(frame.where("k is not null"), "k", "ts", "id", "status"))
    assert rows_of(held.read(0)) == before and held.folders()[0] == 3
    assert len(held.folders()[1]) <= 4 and len(held.read().inputFiles()) <= 4
    assert {r["folder"] for r in held.unreferenced(1).collect()}.isdisjoint(held.folders()[1].values())


def test_rows_of_a_key_are_replaced_together(spark, tmp_path):
    schema = "test long, sort_order int, question string"
    rows = lambda tests, n, tag: spark.createDataFrame([(t, k, f"{tag} {t} {k}") for t in tests for k in range(n)], schema)
    held = ReplacedTable(spark, str(tmp_path / "q"), schema, "test", buckets=3)
    assert held.merge(rows(range(40), 3, "old"), 0) and held.merge(rows([1, 7, 50], 1, "new"), 1) and not held.merge(rows([2], 1, "late"), 1)
    got = sorted(map(tuple, held.read().collect()))
    expected = [tuple(r) for r in rows([t for t in range(40) if t not in (1, 7)], 3, "old").collect()] + [tuple(r) for r in rows([1, 7, 50], 1, "new").collect()]
    assert got == sorted(expected) and len(held.read().inputFiles()) <= 3


def test_a_killed_stream_goes_on_where_it_was(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    held, source = merged(spark, tmp_path / "t"), str(tmp_path / "in")
    for n in range(4):
        frame.where(F.col("id") % 4 == n).coalesce(1).write.mode("append").parquet(source)

    def run(sink):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()

    merge, done = held.sink("events"), []

    def dies(rows, batch):
        merge(rows, batch)
        done.append(batch)
        if batch == 1:  # merged, but the stream doesn't learn of it
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(dies).awaitTermination()
    run(lambda rows, batch: done.append(batch) or merge(rows, batch)).awaitTermination()
    assert done == [0, 1, 1, 2, 3] and held.folders()[0] == 3
    assert rows_of(held.read()) == rows_of(latest(frame, "k", "ts", "id", "status"))


def test_lines_of_a_text_in_many_pieces(spark):
    draw = random.Random(5)
    texts = {d: [draw.choice(["", "  ", "short one", "tab\t\tand  spaces", "x" * 39, "y" * 40, f"a line of its own, number {draw.randrange(60)} of sixty lines", " é "]) for _ in range(n)] for d, n in ((1, 600), (2, 1), (3, 0), (4, 25))}
    rows = [(d, i, t, "z") for d, parts in texts.items() for i, t in enumerate(parts)] + [(5, 0, None, "z"), (None, 0, "no text's line", "z")]
    frame = spark.createDataFrame(rows, "doc long, i int, t string, place string").repartition(7)
    got = paragraph_lines(frame, "doc", "i", "t", piece_lines=16).orderBy("doc", "i").collect()
    whole = {d: "".join(r["piece"] for r in got if r["doc"] == d) for d in (1, 2, 3, 4, 5)}
    expected = {r["d"]: r["c"] for r in spark.createDataFrame([(d, "\n".join(t)) for d, t in texts.items()], "d long, t string").select("d", clean(F.col("t")).alias("c")).collect()}
    assert whole == expected | {5: ""}
    for d in (1, 4):
        mine = [r for r in got if r["doc"] == d]
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1))
        assert mine[-1]["paragraph"] == whole[d].count("\n\n") + 1
    assert paragraph_lines(frame.limit(0), "doc", "i", "t").collect() == []


def test_pages_by_index_are_those_of_sorting(spark, tmp_path):
    draw = random.Random(8)
    rows = [("hot" if i % 3 else f"u{i % 5}", START + timedelta(days=draw.randrange(40)), i, "x") for i in range(3000)] + [(None, START, 9999, "x"), ("one", START, 10_000, "x")]
    frame = spark.createDataFrame(rows, "who string, at timestamp, id long, before string").withColumnRenamed("before", "note").repartition(5)
    index = PageIndex(spark, str(tmp_path / "index"), "who", ["at", "id"], ("at",)).build(frame, tasks=7, block=64)
    order = [F.desc("at"), F.col("id")]
    blocks = index.blocks().collect()
    assert max(r["n"] for r in blocks) <= 64 and len({r["block_"] for r in blocks}) >= 3000 // 64
    for who in ("hot", "u0", "one", "nobody"):
        mine = frame.where(F.col("who") == who)
        assert index.count(who) == mine.count()
        for offset, limit in ((0, 20), (63, 3), (64, 100), (1990, 20), (5000, 20), (-3, 0)):
            got, expected = index.page(who, offset, limit), serving.page(mine, order, limit, offset)
            assert got.columns == frame.columns and got.collect() == expected.collect()
    asked = spark.createDataFrame([("hot", 500, 7), ("hot", 0, 2), ("u1", 100, 1000), ("one", 0, 5), ("one", 1, 5), ("nobody", 0, 5), (None, 0, 5)], "who string, offset int, limit int")
    got = {}
    for r in index.pages(asked).collect():
        got.setdefault(r["who"], []).append((r["place"], r["id"]))
    whole = {who: [r["id"] for r in frame.where(F.col("who") == who).orderBy(*order).collect()] for who in ("hot", "u1", "one")}
    wanted = {"hot": [*range(0, 2), *range(500, 507)], "u1": [*range(100, 200)], "one": [0]}
    assert {w: sorted(v) for w, v in got.items()} == {w: [(k + 1, whole[w][k]) for k in places if k < len(whole[w])] for w, places in wanted.items()}
    # a deep page reads the rows of its blocks, not the list
    plan = index.page("hot", 1500, 5)._jdf.queryExecution().executedPlan().toString()
    assert "block_" in plan and "In(block_" in plan.replace(" ", "") or "block_#" in plan
    empty = PageIndex(spark, str(tmp_path / "empty"), "who", ["at", "id"]).build(frame.limit(0))
    assert empty.page("hot").collect() == [] and empty.pages(asked).collect() == [] and empty.count("hot") == 0


def test_defaults_are_those_of_the_service():
    assert (DEFAULT.rate_requests, DEFAULT.rate_window_s) == (30, 60)
