"""Benchmark decontamination by a positional inverted index of the training tokens.

The index has a posting (row, position, term) for every training token whose word occurs in some test item; other words
can't be in a match. It is stored by document. A query intersects offset-adjusted posting lists from the rarest: the rarest term of
each window of an item gives candidate alignments (position minus offset), of which those stay that the next rarest terms' lists have too,
one list after the other; the postings of all other terms are then looked up at the alignments that are left. Everything is a DataFrame
operation; nothing is collected but counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import small_enough, table, unwrapped, whole, with_broadcast_if, written

#: What stands between words, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Test-side tables of at most so many rows are broadcast (some tens of MB); larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Lists that are intersected one after the other; the alignments that are left are looked up in the rest at once.
RANKS = 3
#: Positions of a block of postings in the search for words near each other.
BLOCK = 64


def words(text):
    """The words of a text column; null has none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), GAP), "")


def _mark(doc_id, text):
    return F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"), 256))


@dataclass
class PositionalIndex:
    """postings(row, doc_id, n_words, pos, term, mark): every row has a posting, if only an empty one at pos 0 or null."""

    postings: DataFrame
    terms: DataFrame
    phrases: DataFrame

    @property
    def documents(self) -> DataFrame:
        return self.postings.where("pos is null or pos = 0").select("row", "doc_id", "n_words", "mark")

    @property
    def lists(self) -> DataFrame:
        return self.postings.where("term is not null").select("row", "pos", "term")


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", marked: bool = False) -> PositionalIndex:
    """Postings of docs for the words of items. Rows of docs are told apart by a key of their own, so ids may repeat or be null.

    marked: the first posting of each row has a digest of its id and text.
    """
    test = items.select(F.col(item_col).cast("string").alias("item_id"), words(F.col(item_text_col)).alias("w"))
    test = test.where(F.size("w") > 0).withColumn("item", F.monotonically_increasing_id())
    test = written(test.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("off", "word")), "items")
    terms = written(test.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    phrases = written(test.join(terms, "word").select("item", "item_id", "n", "off", "term"), "phrases")

    mark = _mark(F.col(id_col), F.col(text_col)) if marked else F.lit(None).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), mark.alias("mark"), words(F.col(text_col)).alias("w"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    tokens = rows.select("row", "doc_id", "mark", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "word"))
    found = tokens.join(with_broadcast_if(terms, BROADCAST_ROWS), "word", "left").where("term is not null or pos is null or pos = 0")
    return PositionalIndex(written(found.select("row", "doc_id", "n_words", "pos", "term", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("mark")).alias("mark")), "postings"), terms, phrases)


def _anchors(index: PositionalIndex, size: int) -> DataFrame:
    """(item, offs, terms, low, high): the RANKS rarest terms of each window, the rarest first; low to high are the offsets of all windows they are for."""
    frequency = index.lists.groupBy("term").agg(F.count("*").alias("df"))
    known = index.phrases.join(frequency, "term", "left")
    per_item = known.groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("off", F.coalesce("df", F.lit(0)).alias("df"), "term"))).alias("a"))
    per_item = per_item.withColumn("size", F.least("n", F.lit(size)))
    starts = F.sequence(F.lit(0), F.col("n") - F.col("size"))
    ranked = lambda s: F.slice(F.array_sort(F.transform(F.slice("a", s + 1, F.col("size")), lambda x: F.struct(x["df"], x["off"], x["term"]))), 1, RANKS)
    each = per_item.select("item", "size", F.explode(F.transform(starts, lambda s: F.struct(s.alias("s"), ranked(s).alias("r")))).alias("w"))
    # a window with a term that no document has can't occur
    each = each.where(F.col("w.r")[0]["df"] > 0).select("item", "size", "w.s", F.col("w.r.off").alias("offs"), F.col("w.r.term").alias("terms"))
    each = each.groupBy("item", "offs", "terms", "size").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    return written(each.select("item", "offs", "terms", "low", (F.col("high") + F.col("size") - 1).alias("high")), "anchors")


def _alignments(index: PositionalIndex, size: int) -> DataFrame:
    """(row, item, shift, low, high): where the rarest terms of a window stand in a document as they do in the item."""
    anchors = _anchors(index, size)
    first = with_broadcast_if(anchors.withColumn("term", F.col("terms")[0]), BROADCAST_ROWS)
    alive = index.lists.join(first, "term").select("row", "item", (F.col("pos") - F.col("offs")[0]).alias("shift"), "offs", "terms", "low", "high")
    for k in range(1, RANKS):
        alive = written(alive, f"alignments{k}")
        some = anchors.where(F.size("terms") > k)
        mine = index.lists.join(with_broadcast_if(some.select(F.col("terms")[k].alias("term")).distinct(), BROADCAST_ROWS), "term", "left_semi")
        rows = alive.select("row").distinct()
        if k > 1 and small_enough(rows, BROADCAST_ROWS):  # few documents are left: only their postings needn't stay where they are
            mine = mine.join(F.broadcast(rows), "row", "left_semi")
        asked = alive.where(F.size("terms") > k).withColumn("pos", F.col("shift") + F.col("offs")[k]).withColumn("term", F.col("terms")[k])
        alive = asked.join(mine, ["row", "pos", "term"], "left_semi").drop("pos", "term").unionByName(alive.where(F.size("terms") <= k))
    return written(alive.select("row", "item", "shift", "low", "high"), "alignments")


def exact_matches(index: PositionalIndex, size: int = 10) -> DataFrame:
    """(row, item, first, last): maximal runs of at least `size` consecutive item words (all of a shorter item's) in a document."""
    starts = _alignments(index, size)
    # two anchors of an alignment may ask for the same offsets
    probes = starts.select("row", "item", "shift", F.explode(F.sequence("low", "high")).alias("off")).distinct()
    phrases = index.phrases.select("item", "off", "term", "n")
    probes = written(probes.join(with_broadcast_if(phrases, BROADCAST_ROWS), ["item", "off"]).select("row", (F.col("shift") + F.col("off")).alias("pos"), "term", "item", "shift", "off", "n"), "probes")
    held = with_broadcast_if(probes.select("row").distinct(), BROADCAST_ROWS)
    lists = index.lists.join(held, "row", "left_semi")
    met = lists.join(probes, ["row", "pos", "term"]).select("row", "item", "shift", "off", "n")
    run = F.col("off") - F.row_number().over(Window.partitionBy("row", "item", "shift").orderBy("off"))
    runs = met.withColumn("run", run).groupBy("row", "item", "shift", "run").agg(F.min("off").alias("a"), F.max("off").alias("b"), F.first("n").alias("n"))
    runs = runs.where(F.col("b") - F.col("a") + 1 >= F.least("n", F.lit(size)))
    return runs.select("row", "item", (F.col("shift") + F.col("a")).alias("first"), (F.col("shift") + F.col("b")).alias("last"))


def proximity_matches(index: PositionalIndex, within: int | None = None) -> DataFrame:
    """(row, item, pos): the places in documents of an item's rarest word that have all the item's other words at most `within` positions away, in any order (twice the item's words if not said).

    The rarest is the word with the fewest postings, the first in order of words among several. Rows without a match give none, nor do items with a word that no document has. Postings meet by
    row, term and block of BLOCK positions, so that a long document's are not paired with all of each other.
    """
    frequency = index.lists.groupBy("term").agg(F.count("*").alias("df"))
    terms = index.phrases.select("item", "n", "term").distinct().join(with_broadcast_if(index.terms, BROADCAST_ROWS), "term").join(frequency, "term", "left").na.fill(0, ["df"])
    terms = written(terms, "near-terms")
    first = terms.groupBy("item", "n").agg(F.min(F.struct("df", "word", "term")).alias("m"), F.count("*").alias("need")).where("m.df > 0")
    reach = F.lit(within) if within is not None else 2 * F.col("n")
    at = index.lists.join(with_broadcast_if(first.select("item", "need", reach.alias("reach"), F.col("m.term").alias("term")), BROADCAST_ROWS), "term").select("row", "item", "need", "pos", "reach")
    at = written(at, "near-starts")
    lists = index.lists.join(with_broadcast_if(at.select("row").distinct(), BROADCAST_ROWS), "row", "left_semi")
    lists = lists.select("row", "term", F.col("pos").alias("other"), F.floor(F.col("pos") / BLOCK).alias("block"))
    blocks = F.sequence(F.floor((F.col("pos") - F.col("reach")) / BLOCK), F.floor((F.col("pos") + F.col("reach")) / BLOCK))
    asked = at.join(with_broadcast_if(terms.select("item", "term"), BROADCAST_ROWS), "item").withColumn("block", F.explode(blocks))
    pairs = asked.join(lists, ["row", "term", "block"]).where(F.abs(F.col("other") - F.col("pos")) <= F.col("reach"))
    near = pairs.groupBy("row", "item", "need", "pos").agg(F.countDistinct("term").alias("have"))
    return near.where("have = need").select("row", "item", "pos")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_sha256) for every row of docs.

    A word is hit if it lies in any occurrence of a window of `size` consecutive item words; an item of fewer words is one
    window. n_near counts the items all of whose words stand near each other (see proximity_matches), near_sha256 is of their ids as items_sha256 is of the others'. Null and wordless texts have no words and no hits, very long ones have postings for all their words; wordless items have no windows. Item ids are compared as
    strings, a repeated one counts once, hits of an item with a null id count as hits but not as an item. Rows with
    repeated or null doc ids get a row each. Columns not named are ignored. No documents: no rows; no items: no hits.
    """
    index = build_index(docs, items, id_col, text_col, item_col, item_text_col)
    named = index.phrases.where("off = 0").select("item", "item_id")
    spans = exact_matches(index, size).join(with_broadcast_if(named, BROADCAST_ROWS), "item")
    per_row = spans.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("ids"),
    )
    start = F.struct(F.lit(-1).cast("int").alias("last"), F.lit(0).cast("long").alias("n"))
    fresh = lambda a, x: F.greatest(x["last"] - F.greatest(x["first"], a["last"] + 1) + 1, F.lit(0)).cast("long")
    covered = F.aggregate("spans", start, lambda a, x: F.struct(F.greatest(a["last"], x["last"]).alias("last"), (a["n"] + fresh(a, x)).alias("n")))["n"]
    per_row = per_row.select("row", covered.alias("hit"), F.size("ids").cast("long").alias("n_ids"), F.array_join("ids", ",").alias("joined"))
    near = proximity_matches(index).select("row", "item").distinct().join(with_broadcast_if(named, BROADCAST_ROWS), "item")
    near = near.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("near_ids"))
    out = index.documents.join(per_row, "row", "left").join(near, "row", "left")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_ids", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("joined", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce(F.size("near_ids"), F.lit(0)).cast("long").alias("n_near"),
        F.sha2(F.coalesce(F.array_join("near_ids", ","), F.lit("")).cast("binary"), 256).alias("near_sha256"),
    )


def uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with all their columns.

    Null, empty and wordless texts stay; texts of any length are read whole. Rows of equal id and text stay or go together, others of equal or
    null id apart. Items without words have no windows. No documents: no rows; no items: all rows.
    """
    index = build_index(docs, items, id_col, text_col, item_col, item_text_col, marked=True)
    hit = index.documents.join(exact_matches(index, size).select("row").distinct(), "row", "left_semi")
    hit = written(hit.select(F.col("mark").alias("mark_")).distinct(), "hit")
    marked = docs.select(_mark(F.col(id_col), F.col(text_col)).alias("mark_"), whole(docs).alias("kept_"))
    return unwrapped(marked.join(with_broadcast_if(hit, BROADCAST_ROWS), "mark_", "left_anti"), "kept_", docs.columns)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP2_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SPLIT} AS w FROM benchmark),
bw AS (SELECT item_id, w, len(w) AS n, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
win AS (SELECT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS k
        FROM (SELECT *, unnest(range(1, n - size + 2)) AS s FROM bw)),
d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS k
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes)),
m AS (SELECT DISTINCT doc_id, dw.size, s, item_id FROM dw JOIN win ON dw.k = win.k AND dw.size = win.size),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
p AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
iw AS (SELECT DISTINCT item_id, n, unnest(w) AS word FROM bw),
df AS (SELECT word, count(*) AS df FROM p GROUP BY word),
rare AS (SELECT item_id, n, min({{'df': coalesce(df, 0), 'word': word}}).word AS word, count(*) AS need FROM iw LEFT JOIN df USING (word) GROUP BY item_id, n),
at_ AS (SELECT p.doc_id, p.pos, rare.item_id, n, need FROM p JOIN rare USING (word)),
nw AS (SELECT a.doc_id, a.item_id, a.pos, a.need FROM at_ a JOIN iw USING (item_id) JOIN p ON p.doc_id = a.doc_id AND p.word = iw.word AND abs(p.pos - a.pos) <= 2 * a.n
       GROUP BY a.doc_id, a.item_id, a.pos, a.need HAVING count(DISTINCT iw.word) = a.need),
nears AS (SELECT doc_id, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near_ids FROM (SELECT DISTINCT doc_id, item_id FROM nw) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nears USING (doc_id)
"""
