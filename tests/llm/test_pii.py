import hashlib
import re

from quizmill.llm.pii import KINDS, detect, joined, op6_pii, redact

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def fine(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def brute(text):
    spans = [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(BASE[kind], text or "") if fine(kind, m[0])]
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_base_spans_of_the_table(spark, sf):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op6_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(expected.encode()).hexdigest()
        assert set(filter(None, expected.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in KINDS] == [expected.count(f"{k}:") for k in KINDS]


HARD = [
    None, "", "a@b.c_d@e.f g", "x@y", "é😀 mail me: a.b+c@d-e.co.uk.", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "001.02.0255.3", "1.2.3.256 000.0.0.0",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "12--34 4111111111111111-5", "0 1 2 3 4 5 6 7 8 9 0 1 2 3 4",
    "+1 (743) 555-3824 +44 20 7946 0958.", "+1 2", "++12345678901", "+1234567890123456", "9" * 30000, "1 " * 8000, "a" * 50000 + "@", "a.b@" * 3000 + "c.d",
    "5555555555554444@x.yz", "1.1.1.1.", ".1.1.1.1", "٣.٣.٣.٣",
]


def test_hard_texts_nulls_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame([(k // 2, t, 1, "x") for k, t in enumerate(HARD)], "doc_id long, text string, base int, spans string")
    got = sorted(tuple(r) for r in detect(docs, keep=("text",)).select("doc_id", joined("base"), "kept.text").collect() if r[2])
    assert got == sorted((k // 2, brute(t), t) for k, t in enumerate(HARD) if t)
    assert detect(docs.limit(0)).collect() == []
    assert len(detect(docs).collect()) == len(HARD)


def test_contexts_add_unseen_identifiers_and_spare_others(spark):
    seeds = [f"please dial number +1 (555) 010-{k:04d} today {k}" for k in range(12)]
    unseen = "please dial number 555 010-7777 today again"
    other = ["build version 555 010-7777x shipped", "page 555-0101 of it", "the the the plain words"]
    docs = spark.createDataFrame(list(enumerate([*seeds, unseen, *other])), "doc_id long, text string")
    got = {r[0]: r[1] for r in detect(docs).select("doc_id", joined("spans")).collect()}
    assert got[12] == "phone:19:31" and unseen[19:31] == "555 010-7777"
    assert not any(got[k] for k in (13, 14, 15)) and all(got[k] for k in range(12))


def test_redact(spark):
    docs = spark.createDataFrame([(1, "to a@b.cd, 1.2.3.4", "en"), (2, None, None), (3, "none", "de")], "doc_id long, text string, lang string")
    out = redact(docs)
    assert out.columns == docs.columns
    odd = docs.withColumnRenamed("lang", "kept.lang").withColumn("row", docs["doc_id"]).withColumn("spans", docs["text"])
    assert redact(odd).columns == odd.columns and redact(odd).count() == 3
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "to <EMAIL>, <IP>", "en"), (2, None, None), (3, "none", "de")]


def test_copies_of_a_text_count_once(spark):
    seeds = [f"please dial number +1 (555) 010-{k:04d} today {k}" for k in range(12)]
    rows = [*seeds, "please dial number 555 010-7777 today again", *["please dial number again today"] * 200]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r[0]: r[1] for r in detect(docs).select("doc_id", joined("spans")).collect()}
    assert got[12] == "phone:19:31"


def test_addresses_without_three_digits_in_a_row(spark):
    seeds = [f"the host at 10.0.{k}.7 went down" for k in range(12)]
    rows = [*seeds, "the host at fe80::a1b:2c:3d went down"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r[0]: r[1] for r in detect(docs).select("doc_id", joined("spans")).collect()}
    assert got[12] == "ip:12:27" and rows[12][12:27] == "fe80::a1b:2c:3d"


def test_long_words_in_a_context_count_like_short_ones(spark):
    for words in ("please call", "p" * 40 + " " + "c" * 40, "p" * 700 + " " + "c" * 700):
        seeds = [f"{words} +1 (555) 010-{k:04d} today {k}" for k in range(12)]
        rows = [*seeds, f"{words} 555 010-7777 today again", *[f"{words} word{chr(97 + k % 26)}{chr(97 + k // 26)} today" for k in range(200)]]
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        got = {r[0]: r[1] for r in detect(docs).select("doc_id", joined("spans")).collect()}
        assert got[12] == "" and all(got[k] for k in range(12))


def test_texts_with_very_many_matches(spark):
    some = [f"x{k}@mail{k % 7}.example" for k in range(20_000)]
    text = " and é ".join(some) + " 1.2.3.4, end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert detect(docs).select(joined("base")).first()[0] == brute(text)
    assert redact(docs).first()["text"] == " and é ".join(["<EMAIL>"] * 20_000) + " <IP>, end"


def test_overlapping_spans_give_way_to_the_first(spark):
    docs = spark.createDataFrame([(1, "a 5555555555554444@x.yz b"), (2, "+5555555555554444 or +44 5555555555554444"), (3, "1.2.3.4@x.yz")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert out[1] == "a <EMAIL> b" and out[3] == "<EMAIL>"
