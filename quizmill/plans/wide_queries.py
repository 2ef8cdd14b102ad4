"""Queries that spread one key, text or set of queries over many tasks, each with its SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.ranking import ranked
from ..functions.text import LINE_END, unnested
from ..operators import admission, boundaries, lines, nearest, paging
from ..sources.tables import shared, table
from .registry import query
from .serving_queries import latest_wins_log
from .text_queries import COS, LINES_CTE, SENTENCES_CTE, WS

#: Users of the driver's events are slow: three calls in two days let some wait.
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SLOW = replace(DEFAULT, rate_requests=3, rate_window_s=172_800)


@query(
    """WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT event_id, user_id, t, k, t AS start FROM r WHERE k <= 3
      UNION ALL SELECT r.event_id, r.user_id, r.t, r.k, greatest(r.t, s.start + 172800000000) FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 3)
    SELECT event_id, user_id, strftime(make_timestamp(start), '%Y-%m-%d %H:%M:%S.%f') AS start_at, start - t AS wait_us FROM s"""
)
def admission_times(spark, sf):
    """M9, W5: when each user's calls may start; pieces of ten days hand on their state"""
    calls = table(spark, sf, "events").select("event_id", "user_id", "ts")
    told = admission.admitted(calls, "user_id", "ts", "event_id", SLOW, piece_s=864_000)
    return told.select("event_id", "user_id", F.date_format("start_at", MICROS).alias("start_at"), "wait_us")


@query(
    f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({COS}, 9) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
    SELECT query_id, vec_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 15"""
)
def nearest_chunks(spark, sf):
    """O2, J7, M2: the 15 nearest of all vectors for every twentieth"""
    vecs = table(spark, sf, "embeddings")
    asked = vecs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest.nearest_of_each(asked, vecs, DEFAULT.max_context_chunks, itself=False)


@query(
    """WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'generating' END AS status FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN status = 'generating' THEN 1 ELSE 0 END, CASE WHEN status = 'generating' THEN -epoch_us(ts) ELSE epoch_us(ts) END, CASE WHEN status = 'generating' THEN -event_id ELSE event_id END) AS k FROM e)
    SELECT user_id, event_id, status FROM r WHERE k = 1"""
)
def merged_stream(spark, sf):
    """K4, L2, K1: the events as a stream of four batches that are merged by user, stopped and started again half way"""
    from ..streaming.merged import MergedTable

    folder = f"{shared(spark)}/merged-{uuid.uuid4().hex}"
    log = latest_wins_log(spark, sf).withColumn("slice", F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / 8)).cast("int"))
    kept = MergedTable(spark, f"{folder}/table", log.drop("slice").schema, "user_id", "ts", "event_id", "status")
    for slices in ((0, 1), (2, 3)):
        for k in slices:  # a file each arrives
            log.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        run = source.writeStream.foreachBatch(kept.sink("events")).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
        run.awaitTermination()
    return kept.read().select("user_id", "event_id", "status")


@query(
    f"""WITH {LINES_CTE}, p AS (SELECT doc_id, i, k, sum(CASE WHEN k = 1 OR length(line) >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS paragraph,
      CASE WHEN k = 1 THEN line WHEN length(line) < 40 THEN ' ' || line ELSE chr(10) || chr(10) || line END AS piece FROM numbered_lines)
    SELECT doc_id, CAST(i AS BIGINT) AS line_ix, CAST(k AS BIGINT) AS place, CAST(paragraph AS BIGINT) AS paragraph, regexp_replace(piece, '[ \\t]+', ' ', 'g') AS piece FROM p"""
)
def clean_lines(spark, sf):
    """W6, T2, T1 over a table of one line a row"""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", LINE_END)).alias("line_ix", "line"))
    return lines.paragraph_lines(rows, "doc_id", "line_ix", "line", piece_lines=64)


@query(
    """SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS place, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders
    QUALIFY place > 5 + o_custkey % 3 AND place <= 10 + o_custkey % 3"""
)
def indexed_pages(spark, sf):
    """O1, A1, S8: a deep page of every owner's list, by an index of blocks; totals from the index too"""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    index = paging.PageIndex(spark, f"{shared(spark)}/pages-{uuid.uuid4().hex}", "o_custkey", ["o_orderdate", "o_orderkey"], ("o_orderdate",)).build(orders)
    asked = orders.select("o_custkey").distinct().select("o_custkey", (5 + F.col("o_custkey") % 3).alias("offset"), F.lit(5).alias("limit"))
    totals = index.blocks().groupBy("o_custkey").agg(F.sum("n").alias("total"))
    return index.pages(asked).join(totals, "o_custkey").select("o_custkey", "o_orderkey", "place", "total")


_TYPE = lambda c: f"translate(regexp_replace({c}, '\\.$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""WITH {SENTENCES_CTE}, w AS (SELECT word FROM (SELECT unnest(string_split_regex(text, '{WS}+')) AS word FROM documents) WHERE regexp_matches(word, '{boundaries.WORD}')),
    t AS (SELECT {_TYPE("word")} AS type, count(*) AS n, count(*) FILTER (WHERE word LIKE '%.') AS ended FROM w GROUP BY 1), s AS (SELECT sum(ended) / CAST(sum(n) AS DOUBLE) AS share FROM t),
    l AS (SELECT type, n, ended, share, length(type) - length(replace(type, '.', '')) AS periods FROM t, s WHERE ended > 0),
    a AS (SELECT type FROM l WHERE -2 * (ended * ln(share) + (n - ended) * ln(1 - share) - ended * ln(0.99) - (n - ended) * ln(1 - 0.99)) * exp(-(length(type) - periods)) * (periods + 1) * pow(CAST(length(type) - periods AS DOUBLE), -(n - ended)) >= 0.3),
    e AS (SELECT doc_id, ix, sentence, list_last(string_split_regex(sentence, '{WS}+')) AS last FROM sents),
    c AS (SELECT doc_id, ix, sentence, CASE WHEN last LIKE '%.' AND regexp_matches(last, '{boundaries.WORD}') AND {_TYPE("last")} IN (SELECT type FROM a) THEN 0 ELSE 1 END AS closes FROM e),
    g AS (SELECT doc_id, ix, sentence, sum(closes) OVER (PARTITION BY doc_id ORDER BY ix) - closes AS sent_ix FROM c)
    SELECT doc_id, CAST(sent_ix AS BIGINT) AS sent_ix, string_agg(sentence, ' ' ORDER BY ix) AS sentence FROM g GROUP BY doc_id, sent_ix"""
)
def sentences_learned(spark, sf):
    """T3: sentences that don't end after what the corpus uses as abbreviations"""
    return boundaries.learned_sentences(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", piece=256)


@query()
def outline_ranked(spark, sf):
    """M6: the ten most central sentences of each document"""
    docs = ranked(table(spark, sf, "documents").select("doc_id", "text"), "text", DEFAULT.outline_max_chunks)
    return unnested(docs, F.col("central"), "sentence_ix", "doc_id").select("doc_id", "sentence_ix", "sentence", F.round("centrality", 9).alias("centrality"))


@query(
    """WITH e AS (SELECT user_id, ts, event_id % 97 = 0 AS done, 86400 * (1 + user_id % 5) AS timeout_s FROM events),
    j AS (SELECT user_id, min(CASE WHEN done THEN ts END) AS ended, max(ts) AS last, count(*) AS beats, any_value(timeout_s) AS wait FROM e GROUP BY user_id)
    SELECT user_id AS job, CASE WHEN ended IS NOT NULL THEN 'completed' ELSE 'failed_timeout' END AS status, strftime(coalesce(ended, last), '%Y-%m-%d %H:%M:%S.%f') AS ended_at, beats
    FROM j WHERE ended IS NOT NULL OR epoch_us(last) + wait * 1000000 <= (SELECT epoch_us(max(ts)) FROM e) - 10000000"""
)
def watched_jobs(spark, sf):
    """L5, L7: the events as heartbeats of a stream, each user with a time-out of its own"""
    from ..streaming import watch

    folder, before = f"{shared(spark)}/watched-{uuid.uuid4().hex}", spark.conf.get(watch.STORE[0], None)
    status = F.when(F.col("event_id") % 97 == 0, "completed").otherwise("generating")
    events = table(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("at"), status.alias("status"), (86400 * (1 + F.col("user_id") % 5)).alias("timeout_s"))
    events.write.parquet(f"{folder}/in")  # what arrives
    beats = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    try:
        watch.with_store(spark)
        out = watch.watched_jobs(beats).writeStream.format("parquet").option("checkpointLocation", f"{folder}/at")
        out.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    finally:
        spark.conf.set(watch.STORE[0], before) if before else spark.conf.unset(watch.STORE[0])
    ended = spark.read.schema(watch.OUT).parquet(f"{folder}/out")
    return ended.select("job", "status", F.date_format("at", MICROS).alias("ended_at"), "beats")
