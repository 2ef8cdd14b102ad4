"""Queries over tests, questions and events: selection, states, lists and exports, each with its SQL.

Orders stand for tests (customers own them), line items for questions, events for heartbeats and requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, FAULTY_CRITIQUES, TOPICS
from ..functions import text
from ..operators import export, lifecycle, pages, selection, serving
from ..sources.tables import table, topics
from .registry import query
from .text_queries import GENERATED_CTE

#: A fixed "now", at the end of the events.
NOW = "2024-01-31 00:00:00"
FAULTY_SQL = "(" + " OR ".join(f"contains(lower(critique), '{p}')" for p in FAULTY_CRITIQUES) + ")"

CANDIDATES_SQL = """cand AS (SELECT doc_id, i AS cand_ix, ['easy','medium','hard'][(doc_id + i) % 3 + 1] AS difficulty,
  CASE WHEN doc_id % 5 = 0 THEN 'Incorrect key here' WHEN doc_id % 11 = 0 THEN 'ok' WHEN (doc_id * 7 + i) % 4 = 0 THEN 'explanation is wrong' WHEN (doc_id * 7 + i) % 4 = 1 THEN 'The correct answer' ELSE 'Looks fine.' END AS critique,
  CASE WHEN doc_id % 11 = 0 THEN 'short' ELSE 'a stem long enough' END AS question, CASE WHEN (doc_id + i) % 13 = 0 THEN ' ' ELSE 'd' END AS d, ['A','B','C','D','E'][i % 5 + 1] AS answer,
  CASE WHEN i % 3 = 0 THEN NULL ELSE ((doc_id + i) % 10) / 10.0 END AS score FROM documents, range(7) r(i) WHERE n_chars >= 500),
shaped AS (SELECT * FROM cand WHERE length(question) >= 8 AND trim(d) <> '' AND answer <> 'E'),
gated AS (SELECT *, NOT {F} AS pass, max(CASE WHEN {F} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id) = 1 AS any_pass FROM shaped),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN any_pass THEN 0 ELSE -coalesce(score, 0.5) END, CASE difficulty WHEN 'medium' THEN 0 WHEN 'easy' THEN 1 ELSE 2 END, cand_ix) AS k FROM gated WHERE pass = any_pass),
kept AS (SELECT *, CASE WHEN any_pass THEN 'strict' ELSE 'quality_fallback' END AS mode FROM ranked WHERE k <= 5)""".replace("{F}", FAULTY_SQL)


def candidates(spark, sf) -> DataFrame:
    """Seven candidates for each longer document, of all shapes and verdicts."""
    d, i = F.col("doc_id"), F.col("cand_ix")
    rows = table(spark, sf, "documents").where("n_chars >= 500").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("cand_ix"))
    pick = lambda values, at: F.array(*map(F.lit, values))[at.cast("int")]
    turn = (d * 7 + i) % 4
    critique = F.when(d % 5 == 0, "Incorrect key here").when(d % 11 == 0, "ok").when(turn == 0, "explanation is wrong").when(turn == 1, "The correct answer").otherwise("Looks fine.")
    last = F.when((d + i) % 13 == 0, " ").otherwise("d")
    return rows.select(
        "doc_id",
        "cand_ix",
        F.when(d % 11 == 0, "short").otherwise("a stem long enough").alias("question"),
        F.create_map(F.lit("A"), F.lit("a"), F.lit("B"), F.lit("b"), F.lit("C"), F.lit("c"), F.lit("D"), last).alias("options"),
        pick("ABCDE", i % 5).alias("correct_option"),
        pick(["easy", "medium", "hard"], (d + i) % 3).alias("difficulty"),
        critique.alias("critique"),
        F.when(i % 3 != 0, ((d + i) % 10) / 10.0).alias("quality_score"),
    )


def _selected(spark, sf) -> DataFrame:
    return selection.select(candidates(spark, sf), "doc_id", 5)


@query(f"WITH {CANDIDATES_SQL} SELECT doc_id, k AS sort_order, cand_ix, difficulty FROM kept WHERE mode = 'strict'")
def select_strict(spark, sf):
    """2.10 strict, P10, P11, O6, W1 to W3"""
    return _selected(spark, sf).where("mode = 'strict'").select("doc_id", "sort_order", "cand_ix", "difficulty")


@query(f"WITH {CANDIDATES_SQL} SELECT doc_id, k AS sort_order, cand_ix, difficulty, CAST(coalesce(score, 0.5) AS DOUBLE) AS score FROM kept WHERE mode = 'quality_fallback'")
def select_fallback(spark, sf):
    """2.10 fallback, O5"""
    return _selected(spark, sf).where("mode = 'quality_fallback'").select("doc_id", "sort_order", "cand_ix", "difficulty", F.coalesce("quality_score", F.lit(0.5)).alias("score"))


@query(
    f"""WITH {CANDIDATES_SQL}, m AS (SELECT doc_id, min(mode) AS mode, count(*) AS kept FROM kept GROUP BY doc_id)
    SELECT d.doc_id, coalesce(mode, 'empty') AS mode, coalesce(m.kept, 0) AS kept, CASE WHEN coalesce(m.kept, 0) = 0 THEN 'failed' WHEN m.kept >= 5 THEN 'completed' ELSE 'partial' END AS status FROM documents d LEFT JOIN m USING (doc_id) WHERE n_chars >= 500"""
)
def select_mode(spark, sf):
    """2.10 mode and final status"""
    return selection.modes(table(spark, sf, "documents").where("n_chars >= 500"), _selected(spark, sf), "doc_id", F.lit(5))


@query(
    f"""WITH {CANDIDATES_SQL} SELECT doc_id, cand_ix, CASE WHEN doc_id % 9 = 0 THEN 'correct_option' WHEN doc_id % 9 = 1 THEN 'difficulty' WHEN doc_id % 9 IN (2, 3) THEN 'options' WHEN cand_ix = 6 THEN 'num_questions' END AS fault FROM cand"""
)
def payload_validation(spark, sf):
    """P12"""
    d = F.col("doc_id") % 9
    labels = F.when(d == 2, F.array(*map(F.lit, "ABC"))).when(d == 3, F.array(*map(F.lit, "ABDC"))).otherwise(F.array(*map(F.lit, "ABCD")))
    fault = selection.payload_fault(F.when(d == 0, "b").otherwise(F.col("correct_option")), F.when(d == 1, "Medium").otherwise(F.col("difficulty")), labels, F.when(F.col("cand_ix") == 6, 21).otherwise(20))
    return candidates(spark, sf).select("doc_id", "cand_ix", fault.alias("fault"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'A=x,B=' || p_brand WHEN p_partkey % 3 = 1 THEN 'A=' || p_brand ELSE '' END AS options FROM part")
def options_normalise(spark, sf):
    """P15, P16"""
    k, brand = F.col("p_partkey") % 3, F.col("p_brand")
    labels = F.when(k == 0, F.array(F.lit("b "), F.lit("a"), F.lit("AB"))).when(k == 1, F.array(F.lit("a"), F.lit("A"), F.lit(""))).otherwise(F.array(F.lit("F"), F.lit("?"), F.lit("ABC")))
    texts = F.when(k == 0, F.array(brand, F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"), brand, F.lit("y")))
    entries = F.array_sort(F.map_entries(text.options_by_label(labels, texts)))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("options"))


@query("SELECT user_id AS key, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_access, row_number() OVER (ORDER BY max(ts) DESC, user_id) AS place FROM events GROUP BY user_id QUALIFY place <= 20")
def lru_cache(spark, sf):
    """W7, J5"""
    out = serving.recent_keys(table(spark, sf, "events"), "user_id", "ts")
    return out.select(F.col("user_id").alias("key"), F.date_format("last_access", "yyyy-MM-dd HH:mm:ss").alias("last_access"), "place")


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS created, count(*) OVER () AS total FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 5 OFFSET 2"""
)
def owner_page(spark, sf):
    """O1, A1, S8"""
    orders = table(spark, sf, "orders")
    user = orders.agg(F.min("o_custkey")).first()[0]
    mine = serving.owned(orders, "o_custkey", user).select("o_orderkey", "o_orderdate")
    total = mine.agg(F.count("*").alias("total"))  # one row beside the page
    out = serving.page(mine, [F.desc("o_orderdate"), F.col("o_orderkey")], 5, 2).join(F.broadcast(total))
    return out.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), "total")


_SLUGS = ", ".join(f"('{s}', {k + 1})" for k, (s, _) in enumerate(TOPICS))


@query(
    f"""WITH t(slug, topic_id) AS (VALUES {_SLUGS}), p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' History ' WHEN 1 THEN 'science' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE p_brand END AS tag FROM part)
    SELECT p_partkey, CAST(coalesce(topic_id, 1) AS BIGINT) AS topic_id FROM p LEFT JOIN t ON lower(trim(coalesce(tag, ''))) = slug"""
)
def slug_lookup(spark, sf):
    """J1, S9"""
    k = F.col("p_partkey") % 5
    tag = F.when(k == 0, " History ").when(k == 1, "science").when(k == 2, "").when(k == 3, None).otherwise(F.col("p_brand"))
    return selection.with_topics(table(spark, sf, "part").select("p_partkey", tag.alias("topic_tag")), topics(spark)).select("p_partkey", "topic_id")


@query(f"SELECT slug, name, CAST(sort_order AS BIGINT) AS sort_order FROM (VALUES {', '.join(f'({k + 1}, {s!r}, {n!r})' for k, (s, n) in enumerate(TOPICS))}) t(sort_order, slug, name)")
def topic_list(spark, sf):
    """S9"""
    return topics(spark).orderBy("sort_order", "slug").select("slug", "name", F.col("sort_order").cast("long").alias("sort_order"))


@query("SELECT o_orderkey, coalesce((SELECT string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS items FROM orders")
def ordered_children(spark, sf):
    """J2, J3, W1"""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    value = F.concat_ws(":", "l_linenumber", "l_partkey")
    keyed = rows.select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey").alias("o"), value.alias("v"))
    parents = table(spark, sf, "orders").select("o_orderkey")
    return serving.children(parents, keyed, "o_orderkey", "o", F.col("v")).select("o_orderkey", F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"))


@query(
    """WITH c AS (SELECT l_orderkey, count(*) AS n, list(l_linenumber) AS l FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_orderkey, greatest(1, least(20, o_orderkey % 8)) AS cap FROM orders)
    SELECT o_orderkey, coalesce(n, 0) AS n, cap, coalesce(n, 0) < cap AS allowed, coalesce(n, 0) + 1 AS next_order, coalesce(list_contains(l, coalesce(n, 0) + 1), false) AS collides FROM o LEFT JOIN c ON l_orderkey = o_orderkey"""
)
def cap_guard(spark, sf):
    """P14, A1"""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return serving.may_add(table(spark, sf, "orders"), rows, "o_orderkey", "l_linenumber", F.col("o_orderkey") % 8)


JOBS_SQL = """c AS (SELECT l_orderkey, count(*) AS done FROM lineitem GROUP BY l_orderkey),
jobs AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'generating' WHEN 'P' THEN 'partial' ELSE 'completed' END AS status, coalesce(done, 0) AS done, o_orderkey % 3 * 7 AS total, o_orderkey % 2 * 9 AS target, o_orderkey % 2000 AS age FROM orders LEFT JOIN c ON l_orderkey = o_orderkey)"""


def _jobs(spark, sf) -> DataFrame:
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("done"))
    status = F.when(F.col("o_orderstatus") == "O", "generating").when(F.col("o_orderstatus") == "P", "partial").otherwise("completed")
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").join(counts, "o_orderkey", "left").select("o_orderkey", status.alias("status"), F.coalesce("done", F.lit(0)).alias("done"), (k % 3 * 7).alias("total"), (k % 2 * 9).alias("target"), (k % 2000).alias("age"))


@query(
    f"""WITH {JOBS_SQL}, d AS (SELECT *, coalesce(nullif(total, 0), nullif(target, 0)) AS d FROM jobs)
    SELECT o_orderkey, coalesce(CAST(round_even(done / CAST(d AS DOUBLE), 2) AS DOUBLE), 0.0) AS progress,
      CASE WHEN d IS NULL THEN status WHEN status = 'generating' THEN 'Generating... usually under 1 minute. ' || done || ' of ' || d || ' questions created' || CASE WHEN age > 600 THEN ' (this may take a while for large documents)' ELSE '' END ELSE done || ' of ' || d || ' questions created' END AS message,
      CASE WHEN total <= 1 THEN 0 ELSE least(done + 3, total - 1) END AS ticked FROM d"""
)
def progress_status(spark, sf):
    """P8, L1"""
    done, total, target = F.col("done"), F.col("total"), F.col("target")
    return _jobs(spark, sf).select(
        "o_orderkey",
        F.coalesce(lifecycle.progress(done, total, target), F.lit(0.0)).alias("progress"),
        lifecycle.status_message(F.col("status"), done, total, target, F.col("age"), F.lit(DEFAULT.stale_after_s)).alias("message"),
        lifecycle.ticked(done, total, F.lit(3)).cast("long").alias("ticked"),
    )


@query(
    f"""WITH {JOBS_SQL}, d AS (SELECT *, coalesce(nullif(total, 0), nullif(target, 0)) AS d FROM jobs)
    SELECT o_orderkey, d AS total_mcq, CAST(round_even(done / CAST(d AS DOUBLE), 2) AS DOUBLE) AS progress, done || ' of ' || d || ' questions created' AS message, status = 'generating' AND age > 1200 AS stale FROM d"""
)
def test_list(spark, sf):
    """P7, P9"""
    done, total, target = F.col("done"), F.col("total"), F.col("target")
    now = F.lit(NOW).cast("timestamp")
    updated = F.timestamp_seconds(F.unix_timestamp(now) - F.col("age"))
    return _jobs(spark, sf).select(
        "o_orderkey",
        lifecycle.denominator(total, target).alias("total_mcq"),
        lifecycle.progress(done, total, target).alias("progress"),
        lifecycle.list_message(done, total, target).alias("message"),
        lifecycle.stale(F.col("status"), updated, updated, now, F.lit(None).cast("int")).alias("stale"),
    )


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def owned_rows(spark, sf):
    """J2, J4"""
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    tests = table(spark, sf, "orders").join(users, "o_custkey", "left_semi").select("o_orderkey")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return tests.join(rows, "o_orderkey").select("o_orderkey", "l_linenumber", "l_partkey")


@query(
    f"""WITH {JOBS_SQL}, s AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(100 * least(1.0, done / CAST(total AS DOUBLE)) + 0.5) AS BIGINT) ELSE 0 END AS share FROM jobs)
    SELECT o_orderkey, CASE status WHEN 'completed' THEN 100 WHEN 'partial' THEN share ELSE least(95, share) END AS percent FROM s"""
)
def screen_progress(spark, sf):
    """P17"""
    return _jobs(spark, sf).select("o_orderkey", lifecycle.screen_progress(F.col("status"), F.col("done"), F.col("total")).alias("percent"))


@query(
    f"""WITH {JOBS_SQL} SELECT o_orderkey, CASE WHEN status = 'generating' AND o_orderkey % 4 = 1 THEN 'failed' ELSE status END AS status, CASE WHEN status = 'generating' AND o_orderkey % 4 = 1 THEN 'Cancelled by user' END AS reason FROM jobs"""
)
def cancel_transition(spark, sf):
    """L8, L9"""
    owner, user = F.col("o_orderkey") % 4, F.lit(1)
    after = lifecycle.cancelled(F.col("status"), owner, user)
    reason = lifecycle.failure(F.lit("Cancelled by user"))["failure_reason"]
    return _jobs(spark, sf).select("o_orderkey", after.alias("status"), F.when(after != F.col("status"), reason).alias("reason"))


@query(
    f"""WITH h AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id),
    s AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'generating' WHEN 1 THEN 'pending' ELSE 'completed' END AS status, CASE WHEN user_id % 5 = 0 THEN 86400 END AS timeout, epoch(TIMESTAMP '{NOW}') - floor(epoch(last)) AS age FROM h)
    SELECT user_id, CAST(age AS BIGINT) AS age, CASE WHEN status <> 'completed' AND age > coalesce(timeout, 1200) THEN 'failed_timeout' ELSE status END AS status FROM s"""
)
def stale_sweep(spark, sf):
    """P9, L4 to L7, T24"""
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    k, now = F.col("user_id"), F.lit(NOW).cast("timestamp")
    rows = last.withColumn("status", F.when(k % 3 == 0, "generating").when(k % 3 == 1, "pending").otherwise("completed")).withColumn("created_at", F.lit(None).cast("timestamp"))
    rows = lifecycle.swept(rows, now, F.when(k % 5 == 0, 86400))
    return rows.select("user_id", text.age_s(F.col("updated_at"), now).alias("age"), "status")


@query(
    f"""WITH h AS (SELECT user_id, max(ts) AS last, count(*) AS beats FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'ready' WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(last)) > 1200 THEN 'extraction_failed' ELSE 'processing' END AS status, CAST(CASE WHEN user_id % 4 = 1 THEN 0 ELSE beats END AS BIGINT) AS progress_page FROM h"""
)
def stale_documents(spark, sf):
    """L6: documents whose extraction gives no sign of life"""
    k = F.col("user_id")
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at"), F.count("*").alias("beats"))
    rows = rows.withColumn("status", F.when(k % 2 == 0, "ready").otherwise("processing")).withColumn("created_at", F.lit(None).cast("timestamp")).withColumn("page", F.when(k % 4 != 1, F.col("beats")))
    gone = lifecycle.swept(rows, F.lit(NOW).cast("timestamp"), F.lit(None).cast("int"), "extraction_failed", ["processing"])
    return gone.select("user_id", "status", F.coalesce("page", F.lit(0)).cast("long").alias("progress_page"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def inflight_conflict(spark, sf):
    """P4"""
    tests = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("completed").alias("status"))
    return lifecycle.conflicts(table(spark, sf, "customer").select("c_custkey"), tests, ["c_custkey"])


@query(
    """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY user_id) AS total FROM events) SELECT user_id, done, total FROM r WHERE done % 5 = 0 OR done = total"""
)
def throttled_progress(spark, sf):
    """L3"""
    job = Window.partitionBy("user_id")
    rows = table(spark, sf, "events").select("user_id", F.row_number().over(job.orderBy("ts", "event_id")).cast("long").alias("done"), F.count("*").over(job).alias("total"))
    return lifecycle.throttled(rows, "done", "total")


def latest_wins_log(spark, sf) -> DataFrame:
    """(user_id, event_id, ts, status) of the events, as states of a job for each user."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("generating")
    return table(spark, sf, "events").select("user_id", "event_id", "ts", status.alias("status"))


def _rates(spark, sf, key: str, config=DEFAULT, split: bool = False) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", key, "ts", F.floor("value").cast("long").alias("spent"))
    return lifecycle.rate_limited(events, [key], "ts", F.col("spent"), config, split)


@query(
    """SELECT event_id, count(*) OVER w AS requests, CAST(sum(floor(value)) OVER w AS BIGINT) AS tokens, count(*) OVER w <= 30 AND sum(floor(value)) OVER w <= 25000 AS allowed FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)"""
)
def rate_window(spark, sf):
    """W5, A4, M9"""
    return _rates(spark, sf, "user_id").select("event_id", "requests", "tokens", "allowed")


@query(
    """SELECT event_id, count(*) OVER w AS requests, CAST(sum(floor(value)) OVER w AS BIGINT) AS tokens, count(*) OVER w <= 3 AND sum(floor(value)) OVER w <= 200 AS allowed FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)"""
)
def token_throttle(spark, sf):
    """W5, A4, M11 over an hour"""
    from dataclasses import replace

    # five types of events, however many events there are
    return _rates(spark, sf, "event_type", replace(DEFAULT, rate_window_s=3600, rate_requests=3, rate_tokens=200), split=True).select("event_id", "requests", "tokens", "allowed")


@query(
    """WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS attempt, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 5 END AS n, CAST(floor(value) AS BIGINT) AS t FROM events),
    b AS (SELECT *, min(CASE WHEN n > 0 THEN attempt END) OVER (PARTITION BY user_id) AS good FROM a WHERE attempt < 3)
    SELECT user_id, min(good) AS attempt, CAST(sum(CASE WHEN attempt = good THEN n ELSE 0 END) AS BIGINT) AS n, CAST(sum(t) FILTER (WHERE good IS NULL OR attempt <= good) AS BIGINT) AS tokens FROM b GROUP BY user_id"""
)
def retry_first_success(spark, sf):
    """W8, A2"""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id") % 5)
    rows = table(spark, sf, "events").select("user_id", (F.row_number().over(order) - 1).cast("long").alias("attempt"), n.cast("long").alias("n"), F.floor("value").cast("long").alias("tokens"))
    return selection.first_success(rows, "user_id", "attempt", "n", "tokens", DEFAULT.generation_attempts)


@query(
    f"WITH {CANDIDATES_SQL} SELECT doc_id, cand_ix // 3 AS batch, count(*) AS size, string_agg(answer, '' ORDER BY cand_ix) AS answers FROM cand GROUP BY doc_id, cand_ix // 3"
)
def validation_batches(spark, sf):
    """M4 batching (three a batch)"""
    rows = candidates(spark, sf).select("doc_id", "cand_ix", F.col("correct_option"), F.floor(F.col("cand_ix") / 3).alias("batch"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("cand_ix", "correct_option"))), lambda x: x["correct_option"])
    return rows.groupBy("doc_id", "batch").agg(F.count("*").alias("size"), F.array_join(ordered, "").alias("answers"))


def _questions(spark, sf) -> DataFrame:
    kept = _selected(spark, sf)
    return kept.select("doc_id", "sort_order", "question", "options", "correct_option", F.concat(F.lit("Because of "), F.col("cand_ix"), F.lit(".")).alias("explanation"), "difficulty", "quality_score", F.col("critique").alias("validation_result"))


@query(
    f"""WITH {CANDIDATES_SQL}
    SELECT doc_id, 1 AS section, k * 10 AS ord, 'Q' || k || '. ' || question AS line FROM kept UNION ALL SELECT doc_id, 1, k * 10 + 1, '  A. a' FROM kept UNION ALL SELECT doc_id, 1, k * 10 + 2, '  B. b' FROM kept
    UNION ALL SELECT doc_id, 1, k * 10 + 3, '  C. c' FROM kept UNION ALL SELECT doc_id, 1, k * 10 + 4, '  D. ' || d FROM kept UNION ALL SELECT doc_id, 2, k * 10, 'Q' || k || '. ' || answer FROM kept
    UNION ALL SELECT doc_id, 3, k * 10, 'Q' || k || '. Because of ' || cand_ix || '.' FROM kept"""
)
def docx_lines(spark, sf):
    """K3"""
    return export.paper_lines(_questions(spark, sf), "doc_id")


@query(
    f"""WITH {CANDIDATES_SQL} SELECT doc_id, '{{"test_id":' || doc_id || ',"mode":"' || min(mode) || '","questions_generated":' || count(*) || ',"mcqs":[' ||
    string_agg('{{"question":"' || question || '","options":{{"A":"a","B":"b","C":"c","D":"' || d || '"}},"correct_option":"' || answer || '","explanation":"Because of ' || cand_ix || '.","difficulty":"' || difficulty || '","topic_tag":"polity","validation_result":"' || critique || '"' || CASE WHEN score IS NULL THEN '' ELSE ',"quality_score":' || CAST(score AS DOUBLE) END || '}}', ',' ORDER BY k) || ']}}' AS json FROM kept GROUP BY doc_id"""
)
def json_export(spark, sf):
    """K2"""
    modes = _selected(spark, sf).select("doc_id", "sort_order", "mode")
    rows = _questions(spark, sf).join(modes, ["doc_id", "sort_order"]).withColumn("topic_tag", F.lit("polity"))
    return export.as_json(rows, "doc_id", "mode")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 2 THEN 0.5 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders"""
)
def patch_merge(spark, sf):
    """P13"""
    base = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    k = F.col("o_orderkey") % 4
    patches = base.where(k % 2 == 0).select("o_orderkey", F.when(k == 0, "F").alias("o_orderstatus"), F.when(k == 2, 0.5).alias("o_totalprice"))
    return lifecycle.patched(base, patches, "o_orderkey")


@query(
    """WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'generating' END AS status FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN status = 'generating' THEN 1 ELSE 0 END, CASE WHEN status = 'generating' THEN -epoch_us(ts) ELSE epoch_us(ts) END, CASE WHEN status = 'generating' THEN -event_id ELSE event_id END) AS k FROM e)
    SELECT user_id, event_id, status FROM r WHERE k = 1"""
)
def latest_wins(spark, sf):
    """K4, L2: the first end of a job holds"""
    return lifecycle.latest(latest_wins_log(spark, sf), "user_id", "ts", "event_id", "status").select("user_id", "event_id", "status")


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS heartbeat, count(*) AS beats FROM events GROUP BY user_id")
def heartbeats(spark, sf):
    """L4"""
    return table(spark, sf, "events").groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("heartbeat"), F.count("*").alias("beats"))


@query(f"WITH {CANDIDATES_SQL} SELECT doc_id, count(*) AS n, CAST(avg(length('Because of ' || cand_ix || '.')) AS DOUBLE) AS mean_length FROM kept GROUP BY doc_id")
def explanation_stats(spark, sf):
    """A3"""
    return _questions(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(F.length("explanation")).alias("mean_length"))


@query("SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY user_id, CAST(json_extract(props, '$.k') AS BIGINT)")
def metadata_fields(spark, sf):
    """Metadata JSON access (P9, P14)"""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("user_id", k.alias("k")).agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS page, CAST(floor(value) AS BIGINT) * 100 AS t FROM events),
    b AS (SELECT user_id, page // 3 AS batch, count(*) AS pages, CAST(sum(t) AS BIGINT) AS tokens FROM p GROUP BY user_id, page // 3),
    s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY user_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
    SELECT user_id, batch, pages, tokens, CAST(before + tokens AS BIGINT) AS spent FROM s WHERE before < 160000"""
)
def page_batches(spark, sf):
    """M11, A2: three pages a call, and the token budget of a run"""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select("user_id", (F.row_number().over(order) - 1).alias("page"), (F.floor("value").cast("long") * 100).alias("t"))
    batches = rows.groupBy("user_id", pages.batch_of(F.col("page")).alias("batch")).agg(F.count("*").alias("pages"), F.sum("t").alias("tokens"))
    return pages.within_budget(batches, "user_id", "batch", "tokens")


@query(
    f"""{GENERATED_CTE} SELECT doc_id, CAST(i + 1 AS BIGINT) AS sort_order, '[Mock] Question ' || (i + 1) || ' (seed ' || substring(sha256(substring(context, 1, 200)), 1, 8) || '): What is the main idea of the given text?' AS question,
    ['A','B','C','D'][i % 4 + 1] AS correct_option, 'medium' AS difficulty, CAST(i % {len(TOPICS)} + 1 AS BIGINT) AS topic_id, CAST(0.8 AS DOUBLE) AS quality_score, 'strict' AS mode FROM asked, range(5) r(i)"""
)
def generated_tests(spark, sf):
    """3.1, M3, M4, M8, W8, J6: context, generation, parsing, verdicts and selection, through the mock as a provider on the workers"""
    from .generate import generated

    return generated(spark, sf)

