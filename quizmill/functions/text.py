"""Text operators as column expressions: all of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ANSWER_LABELS, DEFAULT, FAULTY_CRITIQUES, Config

#: White space and line ends as Unicode-aware string methods know them.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WHITE = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def folded(items: Column, first: Column, step: Callable[[Column, Column], Column], made: str, block: int = 256) -> Column:
    """array<made>: the `out` that step(state, item) gives for each item, while its `state` goes on to the next.

    To append to an array is to copy it. So items are folded by blocks, each into an array of its own: n items cost n * (block + n / block) copies of a reference, not n * n.
    """
    empty = F.expr(f"cast(array() as array<{made}>)")

    def one(held: Column, item: Column) -> Column:
        return let(step(held["state"], item), lambda r: F.struct(r["state"].alias("state"), F.array_append(held["out"], r["out"]).alias("out")))

    def some(held: Column, at: Column) -> Column:
        part = F.aggregate(F.slice(items, at, F.lit(block)), F.struct(held["state"].alias("state"), empty.alias("out")), one)
        return let(part, lambda r: F.struct(r["state"].alias("state"), F.array_append(held["out"], r["out"]).alias("out")))

    start = F.struct(first.alias("state"), F.expr(f"cast(array() as array<array<{made}>>)").alias("out"))
    blocks = F.aggregate(F.sequence(F.lit(1), F.size(items), F.lit(block)), start, some, lambda held: F.flatten(held["out"]))
    return F.when(F.size(items) > 0, blocks).otherwise(empty)


def unnested(rows: DataFrame, structs: Column, given: str, *keep: str) -> DataFrame:
    """A row for each struct of an array expression, with the kept columns; `given` is a field that is never null.

    The outer generator with a filter on its output: from a plain one Catalyst infers a filter that computes the array a second time.
    """
    return rows.select(*keep, F.inline_outer(structs)).where(F.col(given).isNotNull())


def strip(text: Column) -> Column:
    """Without white space at its ends: by characters, as a regular expression would try every space in between."""
    return F.btrim(text, F.lit(WHITE))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lines(text: Column) -> Column:
    """Stripped lines that aren't blank, each once, in the order of their first occurrence."""
    every = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), strip)
    return F.array_distinct(F.array_remove(every, ""))


def paragraphs(parts: Column, config: Config = DEFAULT) -> Column:
    """Lines as paragraphs: what goes between two lines depends only on the length of the second, so one pass joins them all."""
    between = lambda x: F.when(F.length(x) < config.short_line_chars, " ").otherwise("\n\n")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(between(x), x))), "")


def clean(text: Column, config: Config = DEFAULT) -> Column:
    return strip(F.regexp_replace(paragraphs(lines(text), config), r"[ \t]+", " "))


def sentences(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), f"(?<=[.!?]){SPACE}+")
    return F.array_remove(F.transform(parts, strip), "")


def clamp(n: Column, default: int, config: Config = DEFAULT) -> Column:
    """1 to max_target; what isn't a number is the default."""
    return F.greatest(F.lit(1), F.least(F.lit(config.max_target), F.coalesce(n.try_cast("double").try_cast("int"), F.lit(default))))


def difficulty(raw: Column) -> Column:
    upper = F.upper(strip(F.coalesce(raw, F.lit(""))))
    return F.when(upper.isin("EASY", "MEDIUM", "HARD"), F.lower(upper)).otherwise("medium")


def difficulty_rank(d: Column) -> Column:
    lower = F.lower(strip(F.coalesce(F.nullif(d, F.lit("")), F.lit("medium"))))
    return F.when(lower == "medium", 0).when(lower == "easy", 1).otherwise(2)


def faulty(critique: Column, phrases: list[str] | None = None) -> Column:
    lower = F.lower(F.coalesce(critique, F.lit("")))
    return F.exists(F.array(*map(F.lit, FAULTY_CRITIQUES if phrases is None else phrases)).cast("array<string>"), lambda p: F.contains(lower, p))


def critique_score(critique: Column) -> Column:
    lower = F.lower(strip(F.coalesce(critique, F.lit(""))))
    good = F.contains(lower, F.lit("correct")) & ~F.contains(lower, F.lit("incorrect"))
    return F.when(lower == "", 0.5).when(faulty(lower), 0.0).when(good, 1.0).otherwise(0.7)


def final_score(given: Column, critique: Column, valid: Column) -> Column:
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(given.try_cast("double"), critique_score(critique))))
    return F.when(F.coalesce(valid, F.lit(True)), score).otherwise(F.least(score, F.lit(0.3)))


def retrieval_text(tags: Column) -> Column:
    """What chunks are compared with."""
    kept = F.array_join(F.array_remove(F.coalesce(tags, F.array().cast("array<string>")), ""), ", ")
    named = F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, kept).otherwise("general studies")
    return F.concat(F.lit("UPSC questions on "), named, F.lit(": history, polity, economy concepts"))  # fixed values


def context(outline: Column, chunks: Column) -> Column:
    head = F.when(F.coalesce(outline, F.lit("")) != "", F.concat(F.lit("Document outline:\n"), outline, F.lit("\n\n"))).otherwise("")
    return F.concat(head, F.array_join(chunks, "\n\n"))


def sampled_questions(text: Column, config: Config = DEFAULT) -> Column:
    """Questions of a paper: those with a question mark, then numbered lines, then blocks, as long as there are too few; each once, in order."""
    limit = config.sampled_questions
    marked = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![^\n?])[^\n?]{20,}+\?"), F.lit(0)), strip)
    number = rf"(?m)^{SPACE}*(?:Q\.?{SPACE}*)?[0-9]{{1,3}}[)\].:\-]{SPACE}*([^\n]{{20,}})$"
    numbered = F.array_remove(F.transform(F.regexp_extract_all(text, F.lit(number), F.lit(1)), strip), "")
    blocks = F.filter(F.transform(F.split(text, rf"\n{SPACE}*\n"), strip), lambda b: F.length(b) >= 20)
    two = let(marked, lambda m: F.when(F.size(m) < limit, F.concat(m, numbered)).otherwise(m))
    three = let(two, lambda q: F.when(F.size(q) < limit, F.concat(q, blocks)).otherwise(q))
    one_line = F.transform(three, lambda q: strip(F.regexp_replace(q, f"{SPACE}+", " ")))
    return F.slice(F.array_distinct(F.array_remove(one_line, "")), 1, limit)


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n")


def first_words(text: Column, config: Config = DEFAULT) -> Column:
    """At most style_words words; shorter texts as they are."""
    whole = strip(F.coalesce(text, F.lit("")))
    return let(words(text), lambda w: F.when(F.size(w) > config.style_words, F.array_join(F.slice(w, 1, config.style_words), " ")).otherwise(whole))


def topic_instruction(slugs: Column) -> Column:
    return F.concat(F.lit("topic_tag must be exactly one of (output verbatim, no other value): "), F.array_join(slugs, ", "))  # fixed value


def prompt(text: Column, slugs: Column, level: Column, n: Column, style: Column, config: Config = DEFAULT) -> Column:
    """The generation request: style block, topics, difficulty, count (1 to 25) and the text's first prompt_chars characters."""
    block = F.when(F.coalesce(style, F.lit("")) != "", F.concat(F.lit("Style:\n"), style, F.lit("\n\n"))).otherwise("")
    count = F.greatest(F.lit(1), F.least(F.lit(25), n)).cast("string")
    return F.concat(block, topic_instruction(slugs), F.lit("\nDifficulty: "), level, F.lit("\nQuestions: "), count, F.lit("\n\n"), F.substring(text, 1, config.prompt_chars))


def timeout_s(chunks: Column, config: Config = DEFAULT) -> Column:
    return F.lit(config.base_timeout_s) + F.floor(chunks / 10).cast("long") * config.timeout_s_per_ten_chunks


def short_error(message: Column, config: Config = DEFAULT) -> Column:
    return F.substring(message, 1, config.error_chars)


def options_by_label(labels: Column, texts: Column) -> Column:
    """A map of option texts by upper-case label; labels outside A to E are left out, of a repeated label the last stays."""
    pairs = F.filter(F.zip_with(labels, texts, lambda k, v: F.struct(F.upper(strip(k)).alias("k"), v.alias("v"))), lambda p: p["k"].isin(ANSWER_LABELS))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.aggregate(pairs, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))


def screen_word_count(text: Column) -> Column:
    """Words for display: texts of over 400 000 characters are estimated at five characters a word, halves up."""
    n = F.length(text)
    return F.when(n > 400_000, F.greatest(F.lit(1), F.floor(n / 5 + 0.5))).otherwise(word_count(text)).cast("long")


def screen_text(text: Column) -> Column:
    """The text for display, none if it has over 60 000 characters."""
    return F.when(F.length(text) <= 60_000, text)


def content_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def seed(text: Column) -> Column:
    return F.substring(F.sha2(F.substring(text, 1, 200).cast("binary"), 256), 1, 8)


def stable_id(*parts: Column) -> Column:
    """An id that the same parts always get, in the form of a UUID."""
    return F.regexp_replace(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def age_s(at: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(at)


def retryable(message: Column) -> Column:
    """Errors worth another try: rate limits, quotas, overload and server errors."""
    from ..providers import RETRYABLE

    return F.coalesce(F.lower(message).rlike(RETRYABLE.pattern), F.lit(False))
