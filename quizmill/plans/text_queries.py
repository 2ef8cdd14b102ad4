"""Queries over documents: cleaning, chunks, retrieval and model text, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DEFAULT, FAULTY_CRITIQUES, TOPICS
from ..functions import chunking, embedding, parsing, text, vectors
from ..operators import lifecycle, retrieval, serving
from ..providers import mock_mcqs, mock_tokens
from ..sources.tables import kept, table
from .generate import eligible, pages_of
from .registry import query

WS, BREAK = text.SPACE, text.LINE_END
SLUGS = [s for s, _ in TOPICS]
#: At this data's sizes some documents should be over the page limit.
PAGED = replace(DEFAULT, max_pdf_pages=10)

LINES_CTE = f"""
raw_lines AS (SELECT doc_id, unnest(string_split_regex(text, '{BREAK}')) AS line, unnest(range(len(string_split_regex(text, '{BREAK}')))) AS i FROM documents),
stripped AS (SELECT doc_id, regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') AS line, i FROM raw_lines),
kept_lines AS (SELECT doc_id, line, min(i) AS i FROM stripped WHERE line <> '' GROUP BY doc_id, line),
numbered_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM kept_lines),
joined AS (SELECT doc_id, string_agg(CASE WHEN k = 1 THEN line WHEN length(line) < 40 THEN ' ' || line ELSE chr(10) || chr(10) || line END, '' ORDER BY i) AS t FROM numbered_lines GROUP BY doc_id),
cleaned AS (SELECT d.doc_id, d.n_chars, regexp_replace(regexp_replace(coalesce(t, ''), '[ \\t]+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g') AS clean FROM documents d LEFT JOIN joined USING (doc_id))"""
WORDS = lambda c: f"len(list_filter(string_split_regex({c}, '{WS}+'), lambda x: x <> ''))"
ELIGIBLE_CTE = f"{LINES_CTE}, eligible AS (SELECT doc_id, clean AS text FROM cleaned WHERE ceil(n_chars / 1800.0) <= 100 AND length(clean) >= 500 AND {WORDS('clean')} >= 500)"
CHUNKS_CTE = (
    ELIGIBLE_CTE
    + """, chunk_lists AS (SELECT doc_id, CASE WHEN length(text) <= 1500 THEN [text] ELSE list_transform(range(0, length(text), 1300), lambda s: substring(text, s + 1, 1500)) END AS c FROM eligible),
chunks AS (SELECT doc_id, len(c) AS n_chunks, unnest(range(len(c))) AS chunk_ix, unnest(c) AS text FROM chunk_lists)"""
)
SPREAD_CTE = (
    CHUNKS_CTE
    + """, places AS (SELECT DISTINCT doc_id, CAST(round_even(i * (n_chunks - 1) / 14.0, 0) AS BIGINT) AS chunk_ix FROM (SELECT DISTINCT doc_id, n_chunks FROM chunks WHERE n_chunks > 15), range(15) r(i)),
sampled AS (SELECT c.* FROM chunks c WHERE n_chunks <= 15 OR EXISTS (SELECT 1 FROM places p WHERE p.doc_id = c.doc_id AND p.chunk_ix = c.chunk_ix))"""
)


@query(f"WITH {LINES_CTE} SELECT doc_id, clean FROM cleaned")
def clean_text(spark, sf):
    """T1, T2"""
    return table(spark, sf, "documents").select("doc_id", text.clean(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, CAST(length(text) AS BIGINT) AS character_count, CAST({WORDS('text')} AS BIGINT) AS word_count FROM documents")
def extract_stats(spark, sf):
    """P2"""
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("character_count"), text.word_count(F.col("text")).alias("word_count"))


@query(
    f"""SELECT doc_id, source, CAST(ceil(n_chars / 1800.0) AS BIGINT) AS total_pages, CASE WHEN length(text) <= 60000 THEN text END AS shown, CASE WHEN length(text) > 400000 THEN greatest(1, CAST(floor(length(text) / 5.0 + 0.5) AS BIGINT)) ELSE CAST({WORDS('text')} AS BIGINT) END AS words FROM documents"""
)
def document_page(spark, sf):
    """P1, P18, P19"""
    return table(spark, sf, "documents").select("doc_id", "source", pages_of(F.col("n_chars")).cast("long").alias("total_pages"), text.screen_text(F.col("text")).alias("shown"), text.screen_word_count(F.col("text")).alias("words"))


@query(
    f"""WITH {LINES_CTE}, s AS (SELECT *, CASE WHEN ceil(n_chars / 1800.0) > 10 THEN 'rejected' WHEN length(clean) < 500 THEN 'extraction_failed' ELSE 'ready' END AS status FROM cleaned)
    SELECT doc_id, status, CASE WHEN status = 'rejected' THEN 'rejected' WHEN status <> 'ready' THEN 'not ready' WHEN clean = '' THEN 'no text' WHEN {WORDS('clean')} < 500 THEN 'too few words' END AS reason FROM s"""
)
def eligibility(spark, sf):
    """P3, S4"""
    status = lambda t: lifecycle.extraction_status(t, pages_of(F.col("n_chars")), PAGED)
    both = text.let(text.clean(F.col("text")), lambda t: F.struct(status(t).alias("status"), lifecycle.ineligible(status(t), t, PAGED).alias("reason")))
    return table(spark, sf, "documents").select("doc_id", F.inline_outer(F.array(both)))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'not_pdf' WHEN doc_id % 25 = 21 OR doc_id % 25 = 22 OR doc_id % 25 = 23 OR doc_id % 25 = 24 THEN 'bad_num_questions' WHEN doc_id % 11 = 0 THEN 'unreadable' WHEN ceil(n_chars / 1800.0) > 10 THEN 'rejected' ELSE 'processing' END AS status FROM documents"""
)
def upload_gate(spark, sf):
    """S1, S2"""
    d = F.col("doc_id")
    name = F.concat(d.cast("string"), F.when(d % 7 == 0, ".txt").otherwise(".PDF"))
    pages = F.when(d % 11 != 0, pages_of(F.col("n_chars")))
    asked = F.when(d % 25 > 0, d % 25)
    return table(spark, sf, "documents").select("doc_id", lifecycle.upload_status(name, pages, asked, PAGED).alias("status"))


def _fixed(spark, sf):
    docs = eligible(table(spark, sf, "documents"))
    return chunking.exploded(docs, chunking.chunks(F.col("text"), mode="fixed"), "doc_id")


@query(f"WITH {CHUNKS_CTE} SELECT doc_id, CAST(n_chunks AS BIGINT) AS n_chunks, CAST(chunk_ix AS BIGINT) AS chunk_ix, text FROM chunks")
def fixed_chunks(spark, sf):
    """T5, T6"""
    return _fixed(spark, sf).withColumn("chunk_ix", F.col("chunk_ix").cast("long"))


SENTENCES_CTE = f"""sent_lists AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
sents AS (SELECT doc_id, unnest(range(len(s))) AS ix, unnest(s) AS sentence FROM sent_lists)"""


@query(f"WITH {SENTENCES_CTE} SELECT doc_id, CAST(ix AS BIGINT) AS sent_ix, sentence FROM sents")
def sentences(spark, sf):
    """T3"""
    rows = F.transform(text.sentences(F.col("text")), lambda s, i: F.struct(i.cast("long").alias("sent_ix"), s.alias("sentence")))
    return text.unnested(table(spark, sf, "documents"), rows, "sent_ix", "doc_id")


#: Chunks of the sentences in sents.
SEMANTIC_CTE = """l AS (SELECT doc_id, ix + 1 AS i, sentence, length(sentence) + 1 AS w, sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY ix) AS cum, count(*) OVER (PARTITION BY doc_id) AS n FROM sents),
c AS (
  SELECT doc_id, 1 AS k, 1 AS a, (SELECT coalesce(min(x.i) - 1, max(l.n)) FROM l x WHERE x.doc_id = l.doc_id AND x.i > 1 AND x.cum > 1500) AS b, max(l.n) AS n FROM l GROUP BY doc_id
  UNION ALL
  SELECT doc_id, k + 1, a2, (SELECT coalesce(min(x.i) - 1, s.n) FROM l x WHERE x.doc_id = s.doc_id AND x.i > s.b + 1 AND x.cum - (SELECT y.cum - y.w FROM l y WHERE y.doc_id = s.doc_id AND y.i = s.a2) > 1500), n
  FROM (SELECT c.doc_id, c.k, c.b, c.n, (SELECT coalesce(min(x.i), c.b + 1) FROM l x WHERE x.doc_id = c.doc_id AND x.i BETWEEN c.a AND c.b
        AND (SELECT y.cum FROM l y WHERE y.doc_id = c.doc_id AND y.i = c.b) - x.cum + x.w <= 300) AS a2 FROM c WHERE c.b < c.n) s
),
semantic AS (SELECT c.doc_id, CAST(c.k - 1 AS BIGINT) AS chunk_ix, string_agg(l.sentence, ' ' ORDER BY l.i) AS text FROM c JOIN l ON l.doc_id = c.doc_id AND l.i BETWEEN c.a AND c.b GROUP BY c.doc_id, c.k)"""
SEMANTIC_SQL = f"WITH RECURSIVE {SENTENCES_CTE}, {SEMANTIC_CTE} SELECT * FROM semantic"
#: The context that questions are asked on.
GENERATED_CTE = f"""WITH RECURSIVE {ELIGIBLE_CTE}, {SENTENCES_CTE.replace("FROM documents", "FROM eligible")}, {SEMANTIC_CTE},
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_chunks FROM semantic),
asked AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_ix) AS context FROM counted
  WHERE n_chunks <= 15 OR list_contains(list_transform(range(15), lambda i: CAST(round_even(i * (n_chunks - 1) / 14.0, 0) AS BIGINT)), chunk_ix) GROUP BY doc_id)"""


@query(SEMANTIC_SQL)
def semantic_chunks(spark, sf):
    """T4, T6"""
    rows = chunking.exploded(table(spark, sf, "documents"), chunking.chunks(F.col("text")), "doc_id")
    return rows.select("doc_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), "text")


@query(SEMANTIC_SQL)
def semantic_chunks_arrow(spark, sf):
    """T4 for texts of book size"""
    rows = chunking.semantic_arrow(table(spark, sf, "documents").select("doc_id", "text"), "text", 1500, 0.2)
    return rows.select("doc_id", F.posexplode("chunks").alias("chunk_ix", "text")).withColumn("chunk_ix", F.col("chunk_ix").cast("long"))


@query(
    f"""WITH {CHUNKS_CTE} SELECT DISTINCT doc_id, CAST(n_chunks AS BIGINT) AS n_chunks, n_chunks > 9 AS outline, n_chunks <= 15 AS whole, CAST(least(n_chunks, 10) AS BIGINT) AS outline_chunks,
    CAST(1200 + 60 * (n_chunks // 10) AS BIGINT) AS timeout_s FROM chunks"""
)
def chunk_gate(spark, sf):
    """T21, O7, outline gate"""
    docs = eligible(table(spark, sf, "documents"))
    n = F.col("n_chunks")
    rows = docs.select("doc_id", F.size(chunking.chunks(F.col("text"), mode="fixed")).cast("long").alias("n_chunks"))
    return rows.select("doc_id", "n_chunks", (n > DEFAULT.outline_min_chunks).alias("outline"), (n <= DEFAULT.max_context_chunks).alias("whole"), F.least(n, F.lit(DEFAULT.outline_max_chunks)).cast("long").alias("outline_chunks"), text.timeout_s(n).cast("long").alias("timeout_s"))


@query(f"WITH {SPREAD_CTE} SELECT doc_id, CAST(chunk_ix AS BIGINT) AS chunk_ix, md5(text) AS text_md5 FROM sampled")
def uniform_sample(spark, sf):
    """O3"""
    return retrieval.spread_sample(_fixed(spark, sf), 15).select("doc_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {SPREAD_CTE} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_ix) AS context FROM sampled GROUP BY doc_id")
def context_assembly(spark, sf):
    """A5, T12"""
    return retrieval.contexts(retrieval.spread_sample(_fixed(spark, sf), 15), "doc_id")


DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
COS = f"{DOT.format(a='e.embedding', b='q.embedding')} / (sqrt({DOT.format(a='e.embedding', b='e.embedding')}) * sqrt({DOT.format(a='q.embedding', b='q.embedding')}) + 1e-12)"


@query(
    f"""WITH s AS (SELECT e.vec_id, {COS} AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0),
    r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) AS k FROM s)
    SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) AS BIGINT) AS place, round(sim, 6) AS similarity FROM r WHERE k <= 15"""
)
def cosine_topk(spark, sf):
    """T11, O2, J7"""
    vecs = table(spark, sf, "embeddings")
    goal = F.broadcast(vecs.where("vec_id = 0").select(F.col("embedding").alias("goal")))  # one row
    scored = vecs.where("vec_id <> 0").join(goal).select("vec_id", vectors.cosine(F.col("embedding"), F.col("goal")).alias("sim"))
    best = scored.orderBy(F.desc("sim"), "vec_id").limit(15)  # a top-n: no sort of all rows
    return retrieval.top_by(best.withColumn("g", F.lit(1)), ["g"], F.col("sim"), "vec_id", 15).select("vec_id", F.col("place").cast("long").alias("place"), F.round("sim", 6).alias("similarity"))


@query(
    f"""WITH s AS (SELECT e.vec_id, {COS} AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
    SELECT vec_id, round(sim, 6) AS similarity FROM s"""
)
def cosine_scores(spark, sf):
    """T11 in numpy batches"""
    vecs = table(spark, sf, "embeddings")
    goal = vecs.where("vec_id = 0").first()["embedding"]  # one vector
    return vectors.cosine_to(vecs.select("vec_id", "embedding"), "embedding", goal).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    """WITH d AS (SELECT e.vec_id, list_sum(list_transform(range(1, 65), lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) * (CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)))) AS d
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
    r AS (SELECT *, row_number() OVER (ORDER BY d, vec_id) AS k FROM d),
    i AS (SELECT vec_id, d FROM r WHERE k <= 10 AND d <= 0.9 ORDER BY d, vec_id LIMIT 5)
    SELECT vec_id, round(d, 6) AS distance FROM i UNION ALL SELECT vec_id, round(d, 6) FROM (SELECT * FROM d ORDER BY vec_id LIMIT 5) WHERE NOT EXISTS (SELECT 1 FROM i)"""
)
def l2_topk_radius(spark, sf):
    """O4, M2"""
    vecs = table(spark, sf, "embeddings")
    goal = F.broadcast(vecs.where("vec_id = 0").select(F.col("embedding").alias("goal")))
    scored = vecs.join(goal).select("vec_id", vectors.squared_l2(F.col("embedding"), F.col("goal")).alias("distance"))
    return retrieval.nearest_l2(scored, "distance", "vec_id", 5, 0.9).select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH q AS (SELECT label, list(m ORDER BY i) AS embedding FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
    s AS (SELECT e.label, e.vec_id, {COS} AS sim FROM embeddings e JOIN q ON e.label = q.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS k FROM s)
    SELECT CAST(label AS BIGINT) AS label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS place FROM r WHERE k <= 5"""
)
def centroid_retrieval(spark, sf):
    """O2 by group"""
    vecs = table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    # sums by position before the shuffle, not lists of vectors
    means = vecs.groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[k].cast("double")) for k in range(64)]).alias("goal"))
    scored = vecs.join(means, "label").select("label", "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("goal")), 9).alias("sim"))
    best = retrieval.top_by(scored, ["label"], F.col("sim"), "vec_id", 5)
    return best.select(F.col("label").cast("long").alias("label"), "vec_id", F.col("place").cast("long").alias("place"))


@query(
    f"""WITH {ELIGIBLE_CTE} SELECT doc_id, CAST(i AS BIGINT) AS cand_ix, '[Mock] Question ' || (i + 1) || ' (seed ' || substring(sha256(substring(text, 1, 200)), 1, 8) || '): What is the main idea of the given text?' AS question,
    ['A','B','C','D'][i % 4 + 1] AS correct_option, 'Option B (mock)' AS option_b, 'hard' AS difficulty, [{', '.join(f"'{s}'" for s in SLUGS)}][i % 6 + 1] AS topic_tag, CAST(500 + length(text) // 4 AS BIGINT) AS tokens
    FROM eligible, range(7) r(i)"""
)
def mock_questions(spark, sf):
    """M5, M3, T18"""
    docs = eligible(table(spark, sf, "documents")).withColumn("tokens", mock_tokens(F.col("text"))["input"])
    made = mock_mcqs(docs, F.col("text"), SLUGS, 7, " Hard ", "doc_id", "tokens")
    return made.select("doc_id", "cand_ix", "question", "correct_option", F.col("options")["B"].alias("option_b"), "difficulty", "topic_tag", "tokens")


def _stem_sql(k: int, answer: str, tag: str) -> str:
    return f"""'{{"question": "Stem number {k} of ' || doc_id || '", "options": {{"A": "a", "B": 2, "C": "c"}}, "correct_option": "{answer}", "difficulty": "Hard ", "topic_tag": "{tag}"}}'"""


RAW_SQL = f"""SELECT doc_id, CASE doc_id % 6
  WHEN 0 THEN '{{"mcqs": [' || {_stem_sql(1, "b", "Economy")} || ', 5, ' || {_stem_sql(2, "", "none")} || ']}}'
  WHEN 1 THEN '[' || {_stem_sql(1, " c ", "history")} || ']'
  WHEN 2 THEN '```json' || chr(10) || '{{"mcqs": [' || {_stem_sql(1, "D", "polity")} || ']}}' || chr(10) || '```'
  WHEN 3 THEN 'sorry, no questions'
  WHEN 4 THEN '{{"mcqs": [{{"question": "Only a stem", "options": ["x"], "correct_option": 2}}]}}'
  ELSE '{{"mcqs": []}}' END AS raw FROM documents"""


@query(
    f"""WITH raw AS ({RAW_SQL}), body AS (SELECT doc_id, CASE WHEN raw LIKE '```%' THEN regexp_replace(regexp_replace(raw, '^```[^\\n]*\\n', ''), '\\n```$', '') ELSE raw END AS b FROM raw),
    j AS (SELECT doc_id, CAST(b AS JSON) AS j FROM body WHERE json_valid(b)),
    l AS (SELECT doc_id, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE json_extract(j, '$.mcqs[*]') END AS l FROM j),
    e AS (SELECT doc_id, unnest(range(len(l))) AS cand_ix, unnest(l) AS v FROM l)
    SELECT doc_id, CAST(cand_ix AS BIGINT) AS cand_ix, coalesce(v->>'$.question', '') AS question,
      CASE WHEN json_type(v, '$.options') = 'OBJECT' THEN coalesce(v->>'$.options.A', '') ELSE '' END AS a, CASE WHEN json_type(v, '$.options') = 'OBJECT' THEN coalesce(v->>'$.options.B', '') ELSE '' END AS b,
      CASE WHEN json_type(v, '$.options') = 'OBJECT' THEN coalesce(v->>'$.options.D', '') ELSE '' END AS d,
      CASE WHEN trim(coalesce(v->>'$.correct_option', '')) = '' THEN 'A' ELSE upper(trim(v->>'$.correct_option')) END AS correct_option,
      CASE WHEN upper(trim(coalesce(v->>'$.difficulty', ''))) IN ('EASY', 'MEDIUM', 'HARD') THEN lower(trim(v->>'$.difficulty')) ELSE 'medium' END AS difficulty,
      CASE WHEN lower(trim(coalesce(v->>'$.topic_tag', ''))) IN ({', '.join(f"'{s}'" for s in SLUGS)}) THEN lower(trim(v->>'$.topic_tag')) ELSE 'polity' END AS topic_tag
    FROM e WHERE json_type(v) = 'OBJECT'"""
)
def parse_mcqs(spark, sf):
    """T13, T14"""
    d = F.col("doc_id").cast("string")

    def one(k: int, answer: str, tag: str):
        return F.concat(F.lit(f'{{"question": "Stem number {k} of '), d, F.lit(f'", "options": {{"A": "a", "B": 2, "C": "c"}}, "correct_option": "{answer}", "difficulty": "Hard ", "topic_tag": "{tag}"}}'))

    kind = F.col("doc_id") % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit('{"mcqs": ['), one(1, "b", "Economy"), F.lit(", 5, "), one(2, "", "none"), F.lit("]}")))
        .when(kind == 1, F.concat(F.lit("["), one(1, " c ", "history"), F.lit("]")))
        .when(kind == 2, F.concat(F.lit('```json\n{"mcqs": ['), one(1, "D", "polity"), F.lit("]}\n```")))
        .when(kind == 3, "sorry, no questions")
        .when(kind == 4, '{"mcqs": [{"question": "Only a stem", "options": ["x"], "correct_option": 2}]}')
        .otherwise('{"mcqs": []}')
    )
    found = parsing.mcqs(table(spark, sf, "documents").select("doc_id", raw.alias("raw")), "raw", SLUGS, "doc_id")
    return found.select("doc_id", "cand_ix", "question", *[F.col("options")[k].alias(k.lower()) for k in "ABD"], "correct_option", "difficulty", "topic_tag")


@query(
    """WITH r AS (SELECT doc_id, unnest(range(3)) AS i FROM documents)
    SELECT doc_id, CAST(i AS BIGINT) AS cand_ix, CASE WHEN doc_id % 3 = 2 THEN false WHEN doc_id % 3 = 0 AND i = 1 THEN false ELSE true END AS is_valid,
      CASE WHEN doc_id % 3 = 2 THEN 0.5 WHEN doc_id % 3 = 0 THEN [1.0, 0.25, 0.5][i + 1] ELSE [0.75, 0.5, 0.5][i + 1] END AS quality_score,
      CASE WHEN doc_id % 3 = 0 AND i = 1 THEN 'bad' WHEN doc_id % 3 = 1 AND i = 0 THEN 'fine' ELSE '' END AS critique FROM r"""
)
def batch_verdicts(spark, sf):
    """T15, J6"""
    raw = F.when(F.col("doc_id") % 3 == 0, '[{"is_valid": true, "quality_score": 7}, {"is_valid": false, "quality_score": 0.25, "critique": "bad"}]')
    raw = raw.when(F.col("doc_id") % 3 == 1, '```\n[{"quality_score": 0.75, "critique": "fine"}]\n```').otherwise('{"error": 1}')
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(parsing.verdicts(raw, F.lit(3))).alias("i", "v"))
    return rows.select("doc_id", F.col("i").cast("long").alias("cand_ix"), "v.is_valid", "v.quality_score", "v.critique")


@query(
    """SELECT doc_id, CAST(0 AS BIGINT) AS cand_ix, 'stem ' || doc_id AS question, CASE WHEN doc_id % 4 = 0 THEN 'B' ELSE 'A' END AS correct_option, 'easy' AS difficulty, CASE WHEN doc_id % 4 = 0 THEN 'history' ELSE 'polity' END AS topic_tag,
    CAST(CASE WHEN doc_id % 4 = 0 THEN 4 ELSE 5 END AS BIGINT) AS n_options FROM documents WHERE doc_id % 4 IN (0, 1)"""
)
def vision_parse(spark, sf):
    """T16"""
    d, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    options = lambda labels: ", ".join(f'{{"label": "{x}", "text": "t{x}"}}' for x in labels)
    body = lambda labels, answer, tag: F.concat(F.lit('{"questions": [{"question": " stem '), d, F.lit(f'", "options": [{options(labels)}], "correct_option": "{answer}", "difficulty": "hard", "topic_tag": "{tag}"}}]}}'))
    raw = F.when(kind == 0, body("abcd", "b", "History")).when(kind == 1, body("EDCBA", "z", "?")).when(kind == 2, body("ABC", "A", "polity")).otherwise(body("ABCC", "A", "polity"))
    found = parsing.vision_mcqs(table(spark, sf, "documents").select("doc_id", raw.alias("raw")), "raw", F.lit("easy"), SLUGS, "doc_id")
    return found.select("doc_id", "cand_ix", "question", "correct_option", "difficulty", "topic_tag", F.size("options").cast("long").alias("n_options"))


#: A critique for each document.
CRITIQUES = ["", "Looks fine.", "The correct answer is A.", "incorrect key", "Key is wrong", "Wrong answer.", "This is incorrect but correct", "B, C, D are wrong answers", "The EXPLANATION IS WRONG here"]
CRITIQUE_SQL = f"[{', '.join(repr(c) for c in CRITIQUES)}][doc_id % {len(CRITIQUES)} + 1]"
FAULTY_SQL = "(" + " OR ".join(f"contains(lower(c), '{p}')" for p in FAULTY_CRITIQUES) + ")"
SCORE_SQL = f"CASE WHEN trim(c) = '' THEN 0.5 WHEN {FAULTY_SQL} THEN 0.0 WHEN contains(lower(c), 'correct') AND NOT contains(lower(c), 'incorrect') THEN 1.0 ELSE 0.7 END"


def _critiques(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array(*map(F.lit, CRITIQUES))[(F.col("doc_id") % len(CRITIQUES)).cast("int")].alias("c"))


@query(f"SELECT doc_id, CAST({SCORE_SQL} AS DOUBLE) AS score, {FAULTY_SQL} AS faulty FROM (SELECT doc_id, {CRITIQUE_SQL} AS c FROM documents)")
def score_critique(spark, sf):
    """T8, P11"""
    return _critiques(spark, sf).select("doc_id", text.critique_score(F.col("c")).alias("score"), text.faulty(F.col("c")).alias("faulty"))


@query(
    f"""WITH r AS (SELECT doc_id, {CRITIQUE_SQL} AS c, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 1.5 WHEN doc_id % 4 = 2 THEN -0.5 ELSE 0.6 END AS q, doc_id % 5 <> 0 AS ok FROM documents),
    s AS (SELECT doc_id, greatest(0.0, least(1.0, coalesce(CAST(q AS DOUBLE), CAST({SCORE_SQL} AS DOUBLE)))) AS s, ok FROM r) SELECT doc_id, CAST(CASE WHEN ok THEN s ELSE least(s, 0.3) END AS DOUBLE) AS score FROM s"""
)
def final_score(spark, sf):
    """T9"""
    d = F.col("doc_id")
    given = F.when(d % 4 == 0, None).when(d % 4 == 1, "1.5").when(d % 4 == 2, "-0.5").otherwise("0.6")
    return _critiques(spark, sf).select("doc_id", text.final_score(given, F.col("c"), d % 5 != 0).alias("score"))


PAPER_SQL = "'Section ' || doc_id || chr(10) || 'Q. ' || (doc_id % 90 + 1) || ') Consider the  following pair ' || doc_id || chr(10) || 'Which of these statements is right ' || (doc_id % 3) || '?' || chr(10) || chr(10) || text"


@query(
    f"""WITH p AS (SELECT doc_id, {PAPER_SQL} AS t FROM documents),
    a AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '[^\\n?]{{20,}}\\?'), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')) AS m,
      list_filter(list_transform(regexp_extract_all(t, '(?m)^{WS}*(?:Q\\.?{WS}*)?[0-9]{{1,3}}[)\\].:\\-]{WS}*([^\\n]{{20,}})$', 1), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') AS n,
      list_filter(list_transform(string_split_regex(t, '\\n{WS}*\\n'), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: length(x) >= 20) AS b FROM p),
    c AS (SELECT doc_id, CASE WHEN len(m) < 30 THEN list_concat(m, n) ELSE m END AS two, b FROM a),
    e AS (SELECT doc_id, CASE WHEN len(two) < 30 THEN list_concat(two, b) ELSE two END AS l FROM c),
    f AS (SELECT doc_id, unnest(range(len(l))) AS i, trim(regexp_replace(unnest(l), '{WS}+', ' ', 'g')) AS q FROM e),
    g AS (SELECT doc_id, q, min(i) AS i FROM f WHERE q <> '' GROUP BY doc_id, q),
    h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g)
    SELECT doc_id, count(*) AS n, string_agg(k || '. ' || q, chr(10) ORDER BY k) AS sampled FROM h WHERE k <= 30 GROUP BY doc_id"""
)
def question_sampling(spark, sf):
    """T17, W4"""
    d = F.col("doc_id")
    paper = F.concat(F.lit("Section "), d, F.lit("\nQ. "), d % 90 + 1, F.lit(") Consider the  following pair "), d, F.lit("\nWhich of these statements is right "), d % 3, F.lit("?\n\n"), F.col("text"))
    both = text.let(text.sampled_questions(paper), lambda q: F.struct(F.size(q).cast("long").alias("n"), text.numbered(q).alias("sampled")))
    return table(spark, sf, "documents").select("doc_id", F.inline_outer(F.array(both)))


@query("SELECT md5(text) AS content_key, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY md5(text)")
def content_hash_dedupe(spark, sf):
    """T18, J5"""
    return serving.first_copies(table(spark, sf, "documents"), text.content_key(F.col("text")), "doc_id")


@query(
    f"""SELECT doc_id, CAST(CASE WHEN {WORDS('text')} > 400 THEN 400 ELSE {WORDS('text')} END AS BIGINT) AS n,
    CASE WHEN {WORDS('text')} > 400 THEN array_to_string(list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '')[1:400], ' ') ELSE regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') END AS profile,
    substring(text, 1, 512) AS error FROM documents"""
)
def truncations(spark, sf):
    """T19, T23, O7"""
    both = text.let(text.first_words(F.col("text")), lambda t: F.struct(text.word_count(t).alias("n"), t.alias("profile")))
    return table(spark, sf, "documents").select("doc_id", F.inline_outer(F.array(both)), text.short_error(F.col("text")).alias("error"))


@query("SELECT doc_id, regexp_replace(md5(CAST(doc_id AS VARCHAR) || chr(31) || text), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS id FROM documents")
def stable_ids(spark, sf):
    """T25: ids that the same rows always get"""
    return table(spark, sf, "documents").select("doc_id", text.stable_id(F.col("doc_id").cast("string"), F.col("text")).alias("id"))


@query(
    """WITH p AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS page, unnest(string_split(text, chr(10))) AS t FROM documents)
    SELECT doc_id, string_agg(trim(t), chr(10) || chr(10) ORDER BY page) AS text FROM p WHERE trim(t) <> '' GROUP BY doc_id"""
)
def reference_papers(spark, sf):
    """S6 (a line is a page here)"""
    from ..sources.files import paper_text

    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return paper_text(rows, "doc_id")


GOAL_TAGS = [[], SLUGS[:1], [SLUGS[0], SLUGS[2]]]
GOALS_SQL = ", ".join(f"({k}, 'UPSC questions on {named}: history, polity, economy concepts')" for k, named in enumerate(", ".join(tags) or "general studies" for tags in GOAL_TAGS))
TOKENS = lambda c: f"unnest(list_filter(string_split_regex(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WS}+'), lambda x: x <> ''))"


@query(
    f"""WITH {CHUNKS_CTE}, goals(goal_id, goal) AS (VALUES {GOALS_SQL}), tok AS (SELECT doc_id, chunk_ix, {TOKENS("text")} AS word FROM chunks), gtok AS (SELECT goal_id, {TOKENS("goal")} AS word FROM goals),
    holding AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, chunk_ix, word FROM tok) GROUP BY word),
    weights AS (SELECT word, CAST('0x' || substring(md5(word), 1, 7) AS BIGINT) % 64 AS dim, CASE WHEN substring(md5(word), 32, 1) < '8' THEN 1.0 ELSE -1.0 END * (ln((1.0 + (SELECT count(*) FROM chunks)) / (1 + n)) + 1) AS weight FROM holding),
    v AS (SELECT doc_id, chunk_ix, dim, sum(weight) AS value FROM tok JOIN weights USING (word) GROUP BY doc_id, chunk_ix, dim),
    a AS (SELECT goal_id, dim, sum(weight) AS aim FROM gtok JOIN weights USING (word) GROUP BY goal_id, dim),
    s AS (SELECT doc_id, chunk_ix, round(coalesce(sum(value * aim), 0) / (sqrt(sum(value * value)) * any_value(l) + 1e-12), 9) + 0.0 AS sim
      FROM v LEFT JOIN a ON a.goal_id = doc_id % 3 AND a.dim = v.dim JOIN (SELECT goal_id, sqrt(sum(aim * aim)) AS l FROM a GROUP BY goal_id) b ON b.goal_id = doc_id % 3 GROUP BY doc_id, chunk_ix),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, chunk_ix) AS k FROM s)
    SELECT doc_id, CAST(chunk_ix AS BIGINT) AS chunk_ix, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_ix) AS BIGINT) AS place, round(sim, 6) AS similarity FROM r WHERE k <= 5"""
)
def embedded_retrieval(spark, sf):
    """M1, O2: each document's chunks by vectors of their words, against what its own request asks for"""
    parts = kept(_fixed(spark, sf), "chunks").withColumn("goal_id", F.col("doc_id") % 3)  # read four times, cleaned and cut once
    asked = [text.retrieval_text(F.array(*map(F.lit, tags)).cast("array<string>")) for tags in GOAL_TAGS]
    goals = spark.range(1).select(F.posexplode(F.array(*asked)).alias("goal_id", "goal")).withColumn("goal_id", F.col("goal_id").cast("long"))
    near = embedding.similarities(parts, goals, ["doc_id", "chunk_ix"], "goal_id", "text", "goal")
    best = retrieval.top_by(near, ["doc_id"], F.col("similarity"), "chunk_ix", 5)
    return best.select("doc_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), F.col("place").cast("long").alias("place"), (F.round("similarity", 6) + F.lit(0.0)).alias("similarity"))


@query(
    f"""SELECT doc_id, 'UPSC questions on ' || CASE WHEN doc_id % 3 = 0 THEN 'general studies' WHEN doc_id % 3 = 1 THEN 'polity' ELSE 'polity, history' END || ': history, polity, economy concepts' AS goal,
    CASE WHEN doc_id % 2 = 0 THEN 'Style:' || chr(10) || 'terse' || chr(10) || chr(10) ELSE '' END || 'topic_tag must be exactly one of (output verbatim, no other value): {', '.join(SLUGS)}' || chr(10) || 'Difficulty: medium' || chr(10) || 'Questions: ' || greatest(1, least(25, doc_id % 40)) || chr(10) || chr(10) || substring(text, 1, 120000) AS prompt FROM documents"""
)
def prompt_render(spark, sf):
    """T10, T20, T22"""
    d = F.col("doc_id")
    tags = F.when(d % 3 == 0, F.array().cast("array<string>")).when(d % 3 == 1, F.array(F.lit("polity"), F.lit(""))).otherwise(F.array(F.lit("polity"), F.lit("history")))
    style = F.when(d % 2 == 0, "terse")
    asked = text.prompt(F.col("text"), F.array(*map(F.lit, SLUGS)), F.lit("medium"), d % 40, style)
    return table(spark, sf, "documents").select("doc_id", text.retrieval_text(tags).alias("goal"), asked.alias("prompt"))


@query("SELECT doc_id, CAST(r.s // 14 AS BIGINT) AS call, CAST(r.s AS BIGINT) AS first, CAST(least(r.s + 13, ceil(n_chars / 100.0) - 1) AS BIGINT) AS last FROM documents, LATERAL (SELECT unnest(range(0, CAST(ceil(n_chars / 100.0) AS BIGINT), 14)) AS s) r")
def ocr_paging(spark, sf):
    """S3, M11 (a page is 100 characters here)"""
    from ..sources.files import page_ranges

    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(page_ranges(F.ceil(F.col("n_chars") / 100).cast("int"))).alias("call", "r"))
    return rows.select("doc_id", F.col("call").cast("long").alias("call"), F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"))


@query(
    f"""WITH {CHUNKS_CTE}, s AS (SELECT doc_id, chunk_ix, array_to_string(list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '')[1:12], ' ') AS s FROM chunks WHERE n_chunks > 9 AND chunk_ix < 10)
    SELECT doc_id, string_agg('Chunk ' || (chunk_ix + 1) || ': ' || s, chr(10) ORDER BY chunk_ix) AS outline FROM s GROUP BY doc_id"""
)
def outline(spark, sf):
    """M6, T12"""
    from ..operators.style import outlines

    return outlines(_fixed(spark, sf), "doc_id")


@query(
    """SELECT doc_id, greatest(1, least(20, CASE WHEN doc_id % 4 = 0 THEN 15 WHEN doc_id % 4 = 1 THEN doc_id ELSE doc_id % 30 END)) AS target,
    CASE doc_id % 5 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' ELSE 'medium' END AS difficulty, doc_id % 3 = 0 AS retry FROM documents"""
)
def request_fields(spark, sf):
    """P5, P6, M9"""
    d = F.col("doc_id")
    raw = F.when(d % 4 == 0, "none").when(d % 4 == 1, d.cast("string")).otherwise(F.concat((d % 30).cast("string"), F.lit(".9")))
    level = F.when(d % 5 == 0, " Easy ").when(d % 5 == 1, "HARD").when(d % 5 == 2, "tough").when(d % 5 == 3, None).otherwise("medium")
    error = F.when(d % 3 == 0, "HTTP 429: slow down").otherwise("invalid request")
    return table(spark, sf, "documents").select("doc_id", text.clamp(raw, 15).cast("long").alias("target"), text.difficulty(level).alias("difficulty"), text.retryable(error).alias("retry"))
