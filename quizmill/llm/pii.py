"""Personal data by patterns and by bootstrapped contexts, in DataFrame operations only.

Base spans come from four patterns. They are the seeds: the words around them induce lexical patterns (the two words before,
or the word before and the word after). Looser candidates of each kind, and plain words that stand in the same places, are
what a pattern also matches. Scores then go round the graph of patterns and instances: a pattern's score is the mean score of
its distinct instances of that kind (plain words and other kinds count 0), an unseen instance's score is one minus the product
of (1 - score) over its patterns. Candidates that end at ACCEPT or above are added; base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .stage import small_enough, table, with_broadcast_if, written

#: Fixed kinds, in their order.
KINDS = ["email", "ip", "card", "phone"]
#: Same matches as the plain patterns, leftmost and greedy, but each start is tried once a run, and runs are not given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried at all.
HINT = {"email": "@", "ip": ".", "phone": "+"}
#: Candidates: what people also write for these kinds.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\(?[0-9]{2,4}\)?[ .-])?[0-9]{3,4}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
#: What every match of a loose pattern has in it.
LOOSE_HINT = {"email": r"@|[(\[]at[)\]]", "ip": ":", "card": "[0-9]{3}", "phone": "[0-9]{3}"}
#: Distinct seeds that a pattern needs; score from which a candidate is added; rounds of scoring.
SUPPORT, ACCEPT, ROUNDS = 3, 0.8, 5
BROADCAST_ROWS = 100_000
#: Characters beside a span that are read first and next for whole words; where these don't hold them, all of that side is read.
REACH = (64, 1024)
#: Items of an array that one inner fold takes.
FOLD = 256
SPANS, EMPTY = "array<struct<start:int,end:int,value:string>>", "array<struct<start:int,kind:int,end:int>>"


def folded(items: Column, first: Column, step, made: str) -> Column:
    """array<made>: what step(state, item) gives as `out` for each item, its `state` going on to the next.

    Appending copies an array, so items are folded in blocks: an array of n costs n * (FOLD + n / FOLD), not n * n.
    """
    none = F.expr(f"cast(array() as array<{made}>)")

    def one(a: Column, x: Column) -> Column:
        return let(step(a["state"], x), lambda r: F.struct(r["state"].alias("state"), F.array_append(a["out"], r["out"]).alias("out")))

    def block(a: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(items, at, F.lit(FOLD)), F.struct(a["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.array_append(a["out"], r["out"]).alias("out")))

    whole = F.struct(first.alias("state"), F.expr(f"cast(array() as array<array<{made}>>)").alias("out"))
    return F.when(F.size(items) > 0, F.aggregate(F.sequence(F.lit(1), F.size(items), F.lit(FOLD)), whole, block, lambda a: F.flatten(a["out"]))).otherwise(none)


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the matches, in code points, end exclusive."""

    def step(at: Column, x: Column) -> Column:
        return let(at + F.length(x["gap"]), lambda begin: let(begin + F.length(x["value"]), lambda end: F.struct(end.alias("state"), F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")).alias("out"))))

    def places(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(values))
        pairs = F.zip_with(gaps, values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        return F.when(F.size(values) > 0, let(pairs, lambda p: folded(p, F.lit(0).cast("int"), step, "struct<start:int,end:int,value:string>"))).otherwise(F.expr(f"cast(array() as {SPANS})"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        d = _digits(value)
        return F.length(d).between(14, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def spans_of(text: Column, patterns: dict[str, str], hints: dict[str, Column], checked: bool) -> Column:
    """array<struct<start, kind (its place in KINDS), end, value>>, unsorted. hints: which texts a kind's pattern is tried on, if not all."""
    each = []
    for k, kind in enumerate(KINDS):
        spans = found(text, patterns[kind])
        if kind in hints:
            spans = F.when(hints[kind], spans).otherwise(F.expr(f"cast(array() as {SPANS})"))
        if checked:
            spans = F.filter(spans, lambda s: valid(kind, s["value"]))  # noqa: B023  called at once
        each.append(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))  # noqa: B023
    return F.flatten(F.array(*each))


def plain(text: Column) -> Column:
    """Words as patterns see them: lower case, only letters, digits, = and :."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\p{L}0-9=:\s]+", "")), r"\s+", " ")), " ")


def _whole_words(cut, whole: Column, length: Column, need: int) -> Column:
    """Words beside a span, `need` of them whole: of the first reach that has one more, the last one of which may be cut, else of the whole side."""
    found = plain(whole)
    for reach in reversed(REACH):
        found = let(plain(cut(reach)), lambda w: F.when((F.size(w) > need) | (length <= reach), w).otherwise(found))  # noqa: B023  called at once
    return found


def _contexts(text: Column, length: Column, near: Column, at: Column, span: Column) -> Column:
    """Keys of the patterns around a span. Words are whole, however long, as they are where plain words are read.

    near: the text from position `at`, which reaches beyond the span on both sides.
    """
    start, end = span["start"], span["end"]
    left = _whole_words(lambda k: F.substring(near, F.greatest(start - at - k + 1, F.lit(1)), F.least(start - at, F.lit(k))), F.substring(text, F.lit(1), start), start, 2)
    right = _whole_words(lambda k: F.substring(near, end - at + 1, F.lit(k)), F.substring(text, end + 1, length - end), length - end, 1)

    def keys(w: Column) -> Column:
        one, two = F.coalesce(F.try_element_at(w, F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at(w, F.lit(-2)), F.lit(""))
        return F.array(F.concat(F.lit("< "), two, F.lit(" "), one), F.concat(F.lit("| "), one, F.lit(" "), right[0]))

    return let(left, keys)


def with_contexts(text: Column, spans: Column) -> Column:
    """The spans with the keys of their contexts. Blocks of them share a cut of the text: finding a place in a text takes as long as what is before it."""

    def block(first: Column) -> Column:
        return let(F.slice(spans, first, F.lit(FOLD)), around)

    def around(some: Column) -> Column:
        at = F.greatest(F.array_min(F.transform(some, lambda s: s["start"])) - REACH[-1], F.lit(0))
        end = F.array_max(F.transform(some, lambda s: s["end"])) + REACH[-1]
        return let(at, lambda a: let(F.substring(text, a + 1, end - a), lambda near: F.transform(some, lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"], _contexts(text, F.length(text), near, a, s).alias("keys")))))

    blocks = F.when(F.size(spans) > 0, F.sequence(F.lit(1), F.size(spans), F.lit(FOLD))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.flatten(F.transform(blocks, block))


def clear_of(loose: Column, base: Column) -> Column:
    """The loose spans that overlap no base span: what begins before and reaches in, then what begins inside, in one pass each."""
    made = "struct<start:int,loose:boolean,end:int,kind:int,value:string,hit:boolean>"
    marked = lambda spans, flag: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(flag).alias("loose"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), F.lit(False).alias("hit")))
    hit = lambda s, now: F.struct(s["start"], s["loose"], s["end"], s["kind"], s["value"], (s["hit"] | now).alias("hit")).alias("out")

    def before(reach: Column, s: Column) -> Column:
        return F.struct(F.when(s["loose"], reach).otherwise(F.greatest(reach, s["end"])).alias("state"), hit(s, reach > s["start"]))

    def after(begin: Column, s: Column) -> Column:
        return F.struct(F.when(s["loose"], begin).otherwise(s["start"]).alias("state"), hit(s, begin < s["end"]))

    every = F.array_sort(F.concat(marked(base, False), marked(loose, True)))
    once = let(every, lambda e: folded(e, F.lit(0).cast("int"), before, made))
    twice = let(F.reverse(once), lambda e: folded(e, F.lit(2**31 - 1).cast("int"), after, made))
    left = F.transform(F.filter(twice, lambda s: s["loose"] & ~s["hit"]), lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"]))
    return F.when((F.size(loose) > 0) & (F.size(base) > 0), F.reverse(left)).otherwise(loose)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, base, spans, kept): a row for each of docs. base and spans are array<struct<start, kind, end>>, sorted; spans has the
    base spans and those that the bootstrapping adds. kept: a struct of the columns in keep (null if none).

    Null and empty texts have no spans; very long ones are read whole. Repeated and null ids give a row each; copies of a value count once as an instance. Columns not
    named are ignored. No rows: no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")).alias("kept"))
    rows = rows.withColumn("text", text)
    seen = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "kept", "text", spans_of(F.col("text"), BASE, {k: F.contains("text", F.lit(h)) for k, h in HINT.items()}, True).alias("base"))
    loose = spans_of(F.col("text"), LOOSE, {k: F.col("text").rlike(h) for k, h in LOOSE_HINT.items()}, False)
    seen = seen.withColumn("loose", loose).withColumn("more", clear_of(F.col("loose"), F.col("base")))
    seen = written(seen.select("row", "doc_id", "kept", with_contexts(F.col("text"), F.col("base")).alias("base"), with_contexts(F.col("text"), F.col("more")).alias("more")), "spans")
    added = _bootstrap(rows, seen)
    bare = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    out = seen.select("row", "doc_id", "kept", F.array_sort(bare).alias("base"), F.size("more").alias("n_more"))
    if added is None:
        return out.select("doc_id", "base", F.col("base").alias("spans"), "kept")
    added = written(added, "added")
    if small_enough(added, BROADCAST_ROWS):
        out = out.join(F.broadcast(added), "row", "left")
    else:  # only rows that have candidates are shuffled
        none = out.where("n_more = 0").withColumn("added", F.lit(None).cast(EMPTY))
        out = none.unionByName(out.where("n_more > 0").join(added, "row", "left"))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", F.expr(f"cast(array() as {EMPTY})")))).alias("spans"), "kept")


def _bootstrap(rows: DataFrame, seen: DataFrame) -> DataFrame | None:
    """(row, added) for rows in which candidates are accepted; None if no pattern has support or none matches a candidate."""
    edge = lambda name, known: seen.where(F.size(name) > 0).select(F.explode(name).alias("s")).select("s.kind", "s.value", F.explode("s.keys").alias("key")).distinct().withColumn("known", F.lit(known))
    seeds = edge("base", True)
    patterns = seeds.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("kind", "key")
    # a pattern around no unseen candidate of its kind adds nothing, and no score depends on it
    patterns = written(patterns.join(edge("more", False).select("kind", "key").distinct(), ["kind", "key"], "left_semi"), "patterns")
    if not patterns.limit(1).count():
        return None
    # every instance that stands in an induced context, whatever its kind
    edges = written(seeds.unionByName(edge("more", False)).withColumnRenamed("kind", "own").join(patterns, "key"), "edges")
    keys = with_broadcast_if(patterns.select("key").distinct(), BROADCAST_ROWS)
    w = rows.select(plain(F.col("text")).alias("w")).select("w", F.posexplode_outer("w").alias("at", "word"))
    at = lambda k: F.coalesce(F.get("w", F.col("at") + k), F.lit(""))
    w = w.where(~F.col("word").rlike("[0-9]")).select(F.explode(F.array(F.concat(F.lit("< "), at(-2), F.lit(" "), at(-1)), F.concat(F.lit("| "), at(-1), F.lit(" "), at(1)))).alias("key"), "word")
    words = written(w.join(keys, "key").groupBy("key").agg(F.count_distinct("word").alias("words")), "words")
    edges = edges.withColumn("same", F.col("own") == F.col("kind"))
    score = None
    for _ in range(ROUNDS):
        if score is None:
            now = edges.withColumn("score", F.when(F.col("known") & F.col("same"), 1.0).otherwise(0.0))
        else:
            now = edges.join(score, ["own", "value"], "left").withColumn("score", F.when(~F.col("same"), 0.0).when(F.col("known"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        trust = now.groupBy("kind", "key").agg(F.sum("score").alias("yes"), F.count("*").alias("n")).join(words, "key", "left")
        trust = trust.select("kind", "key", (F.col("yes") / (F.col("n") + F.coalesce("words", F.lit(0)))).alias("trust"))
        open_ = edges.where(~F.col("known") & F.col("same")).join(trust, ["kind", "key"])
        score = open_.groupBy("own", "value").agg((1 - F.product(1 - F.col("trust"))).alias("score"))
        score = written(score, "scores")
    good = score.where(F.col("score") >= ACCEPT).select(F.col("own").alias("kind"), "value")
    cand = seen.where(F.size("more") > 0).select("row", F.explode("more").alias("s")).select("row", "s.start", "s.kind", "s.end", "s.value").join(good, ["kind", "value"])
    spans = cand.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("a"))
    return spans.select("row", disjoint(F.col("a")).alias("added"))


def disjoint(spans: Column) -> Column:
    """Sorted spans without those that overlap an earlier one that stays."""

    def step(end: Column, s: Column) -> Column:
        return F.struct(F.when(end <= s["start"], s["end"]).otherwise(end).alias("state"), F.struct(s["start"], s["kind"], s["end"], (end <= s["start"]).alias("stays")).alias("out"))

    marked = folded(spans, F.lit(0).cast("int"), step, "struct<start:int,kind:int,end:int,stays:boolean>")
    return F.transform(F.filter(marked, lambda s: s["stays"]), lambda s: F.struct(s["start"], s["kind"], s["end"]))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span in its text replaced by the upper-case name of its kind in angle brackets; overlapping spans by the first's.

    Null texts stay null, empty ones empty; texts of any length are read whole. All columns and rows are kept, repeated ones too. No rows: no rows.
    """
    hits = detect(docs, id_col, text_col, keep=tuple(docs.columns))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col(f"kept.{text_col}")

    def clean(spans: Column) -> Column:
        def block(first: Column) -> Column:  # as in with_contexts, blocks share a cut of the text
            some, at = F.slice(spans, first, F.lit(FOLD)), F.coalesce(F.get(spans, first - 2)["end"], F.lit(0))
            return let(F.struct(some.alias("some"), at.alias("at")), lambda x: let(F.substring(text, x["at"] + 1, F.element_at(x["some"], -1)["end"] - x["at"]), lambda near: masked(near, x["at"], x["some"])))

        def masked(near: Column, at: Column, some: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                end = F.coalesce(F.get(some, k - 1)["end"], at)
                return F.concat(F.substring(near, end - at + 1, s["start"] - end), names[s["kind"]])

            return F.array_join(F.transform(some, one), "")

        parts = F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(FOLD)), block)
        end = F.element_at(spans, -1)["end"]
        return F.concat(F.array_join(parts, ""), F.substring(text, end + 1, F.length(text) - end))

    out = F.when(F.size("spans") > 0, let(disjoint(F.col("spans")), clean)).otherwise(text)
    return hits.select(*[out.alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in docs.columns])


def op6_pii(spark, sf_dir: str) -> DataFrame:
    hits = detect(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]  # noqa: B023
    return hits.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
