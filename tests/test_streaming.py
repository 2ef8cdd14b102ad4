import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quizmill.operators import lifecycle
from quizmill.streaming import jobs, watch


@pytest.fixture()
def stream(spark, tmp_path):
    """Runs a query over batches that arrive as files, one a trigger; its rows."""

    def run(batches, schema, plan, mode="append"):
        folder, name = tmp_path / "in", f"out_{abs(hash(str(tmp_path)))}"
        folder.mkdir()
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        q = plan(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            for k, rows in enumerate(batches):
                part = tmp_path / f"part{k}"
                spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
                for f in part.glob("part-*.parquet"):
                    f.rename(folder / f"{k}.parquet")
                q.processAllAvailable()
            return spark.table(name).collect()
        finally:
            q.stop()

    return run


def at(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def test_stale_jobs_time_out_and_ended_ones_do_not(stream):
    batches = [[(1, at(0), "generating"), (2, at(0), "pending")], [(2, at(900), "completed"), (3, at(1000), "generating")], [(3, at(1300), "generating")], [(4, at(1400), "pending")], [(5, at(1500), "pending")]]
    rows = stream(batches, "job long, at timestamp, status string", jobs.stale_jobs)
    assert sorted((r["job"], r["status"]) for r in rows) == [(1, "failed_timeout"), (2, "completed")]


def test_late_heartbeats_open_no_ended_job(stream):
    batches = [[(1, at(0), "generating")], [(1, at(5), "completed")], [(1, at(6), "generating"), (1, at(4), "failed")], [(2, at(1500), "pending")], [(3, at(1600), "pending")], [(4, at(4000), "pending")], [(5, at(4100), "pending")]]
    rows = stream(batches, "job long, at timestamp, status string", jobs.stale_jobs)
    assert sorted((r["job"], r["status"]) for r in rows if r["job"] == 1) == [(1, "completed")]
    assert (2, "failed_timeout") in {(r["job"], r["status"]) for r in rows}


def test_request_rates(stream):
    batches = [[("a", at(k), 10_000) for k in range(3)], [("a", at(500), 1)], [("a", at(900), 1)]]
    rows = stream(batches, "k string, ts timestamp, n long", lambda s: jobs.request_rates(s, "k", "ts", "n"))
    whole = [r for r in rows if r["start"] == at(0)]
    assert [(r["requests"], r["tokens"], r["allowed"]) for r in whole] == [(3, 30_000, False)]


def test_progress_and_intake(stream):
    batches = [[(1, at(0), 1), (1, at(30), 4)], [(1, at(1000), 5)], [(1, at(2000), 6)]]
    rows = stream(batches, "job long, ts timestamp, done int", lambda s: jobs.job_progress(s, "job", "ts", "done"))
    assert (4, at(30)) in [(r["done"], r["heartbeat"]) for r in rows]


def test_extracted(stream):
    rows = stream([[(1, "word " * 200, 3), (2, "short", 1), (3, "word " * 200, 101)]], "doc_id long, text string, pages int", jobs.extracted)
    assert sorted((r["doc_id"], r["status"], r["words"]) for r in rows) == [(1, "ready", 200), (2, "extraction_failed", 1), (3, "rejected", 200)]


WATCHED = "job long, at timestamp, status string, timeout_s long"


@pytest.fixture()
def store(spark):
    spark.conf.set(*watch.STORE)
    yield
    spark.conf.unset(watch.STORE[0])


def ends(rows):
    return sorted((r["job"], r["status"], r["at"], r["beats"]) for r in rows)


def test_jobs_have_time_outs_of_their_own(stream, store):
    batches = [
        [(1, at(0), "generating", 100), (2, at(0), "pending", None), (3, at(0), "generating", 5000), (None, at(0), "pending", 1), (4, at(0), "ready", 1)],
        [(9, at(200), "pending", 10_000)],  # the watermark goes to 190: job 1 is out
        [(1, at(195), "completed", None), (2, at(300), "generating", 60), (2, at(290), "pending", 900)],
        [(9, at(500), "pending", 10_000)],  # 490: job 2's newest heartbeat gave it 60 seconds
        [(3, at(600), "failed", None), (3, at(590), "completed", None)],
        [(9, at(1000), "pending", 10_000)],
    ]
    rows = stream(batches, WATCHED, watch.watched_jobs)
    assert ends(rows) == [(1, "failed_timeout", at(0), 1), (2, "failed_timeout", at(300), 3), (3, "completed", at(590), 3)]
    assert {r["job"]: r["longest_gap_s"] for r in rows} == {1: 0.0, 2: 290.0, 3: 590.0}


def test_watched_jobs_are_those_of_the_sweep(spark, stream, store):
    draw = random.Random(4)
    rows = [(k, at(t), draw.choice(["generating", "pending"]), None) for t in range(0, 6000, 40) for k in [draw.randrange(12)] if k < 6 or t < 3000]
    last = max(r[1] for r in rows)
    batches = [[r for r in rows if at(n * 1500) <= r[1] < at((n + 1) * 1500)] for n in range(4)] + [[(99, last + timedelta(seconds=11), "pending", None)], [(99, last + timedelta(seconds=12), "pending", None)]]
    got = {r["job"] for r in stream(batches, WATCHED, watch.watched_jobs)}
    newest = spark.createDataFrame(rows, WATCHED).groupBy("job").agg(F.max("at").alias("updated_at")).withColumn("status", F.lit("generating")).withColumn("created_at", F.col("updated_at"))
    swept = {r["job"] for r in lifecycle.swept(newest, F.lit(last), F.lit(None).cast("long")).where("status = 'failed_timeout'").collect()}
    beats = {j: sorted(r[1] for r in rows if r[0] == j) for j in range(12)}
    paused = {j for j, b in beats.items() if any(y - x > timedelta(seconds=1200) for x, y in zip(b, b[1:], strict=False))}
    assert swept == set(range(6, 12)) and swept <= got <= swept | paused  # a sweep sees only the last state; the stream also saw jobs that were silent for too long before


def test_watches_go_on_after_a_restart_and_their_state_goes(spark, store, tmp_path):
    source, found = str(tmp_path / "in"), []

    def run():
        frame = spark.readStream.schema(WATCHED).option("maxFilesPerTrigger", 1).parquet(source)
        out = watch.watched_jobs(frame).writeStream.foreachBatch(lambda b, _: found.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck"))
        q = out.trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress and q.lastProgress["stateOperators"] else None

    for rows in ([(1, at(0), "generating", 100), (2, at(0), "pending", 100)], [(2, at(50), "completed", 100)], [(3, at(130), "pending", 10_000)], [(3, at(1000), "failed", 10)], [(5, at(3000), "completed", 10)], [(6, at(5000), "completed", 1)], [(6, at(5001), "completed", 1)]):
        spark.createDataFrame(rows, WATCHED).coalesce(1).write.mode("append").parquet(source)
        run()
    assert ends(found)[:3] == [(1, "failed_timeout", at(0), 1), (2, "completed", at(50), 2), (3, "failed", at(1000), 2)]
    assert len({r["job"] for r in found}) == len(found) == 5
    left = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "ck"))
    assert {r["job"] for r in left.select("key.job").collect()} == {6}  # the others' state has gone
