import hashlib
import re
import zlib
from html import unescape

from quizmill.llm.media import SCHEME, SequenceParser, as_pages, documents_as_media, features, interleaved, load, media_table, op10_media, payloads, resolve, sequences, store


def brute(text):
    data = (text or "").encode()
    payload = data + b"\0" * (-len(data) % 64 if data else 64)
    return (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_the_query(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = op10_media(spark, sf).collect()
    assert sorted((r[0], *r[1:5]) for r in rows) == sorted((d, *brute(t)) for d, t in texts)
    by_text = {d: t for d, t in texts}
    for r in rows:
        stored = store(by_text[r["doc_id"]].encode())
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_nulls_ties_empty_and_extra_columns(spark):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "<img src=x> & <script>"), (4, "é" * 40000), (5, "\0"), (6, "a" * 64)]
    docs = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, digest string, pos int")
    got = documents_as_media(docs).collect()
    assert sorted(((r[0], *r[1:5]) for r in got), key=str) == sorted(((d, *brute(t)) for d, t in rows), key=str)
    same = [tuple(r[1:]) for r in got if r[0] in (1, 2)]
    assert same[0] == same[1] and len({tuple(r[1:]) for r in got if r[0] == 3}) == 1
    assert {(r["doc_id"], r["pos"], r["caption"]) for r in got} == {(d, int(bool((t or "").strip())), f"{len((t or '').encode())} bytes") for d, t in rows} and documents_as_media(docs.limit(0)).collect() == []


def test_sequences_keep_order_and_captions(spark):
    html = '<html><title>t</title><body><p>one <b>two</b></p><figure><img src="a" alt="x"><figcaption>cap &amp; b</figcaption></figure>three<img src="media:sha256:zz" alt="y"><script>no</script><p>four'
    assert SequenceParser().sequence(html) == [["text", "one two", None, None], ["media", None, "a", "cap & b"], ["text", "three", None, None], ["media", None, "media:sha256:zz", "y"], ["text", "four", None, None]]
    docs = spark.createDataFrame([("payload",)], "text string")
    digest = hashlib.sha256(store(b"payload")).hexdigest()
    pages = spark.createDataFrame([(1, f'<p>a</p><img src="{SCHEME}{digest}"><p>b</p><img src="gone">'), (2, None)], "page_id long, html string")
    out = resolve(interleaved(pages), features(media_table(docs))).orderBy("pos").collect()
    assert [(r["pos"], r["kind"], r["n_bytes"]) for r in out] == [(0, "text", None), (1, "media", 7), (2, "text", None), (3, "media", None)]
    whole = sequences(resolve(interleaved(pages), features(media_table(docs)))).first()["items"]
    assert [(x["pos"], x["text"], x["payload_bytes"]) for x in whole] == [(0, "a", None), (1, None, 64), (2, "b", None), (3, None, None)]


def test_store_is_lossless():
    for data in (b"", b"x", b"x\0", b"y" * 64, bytes(range(256)) * 3):
        n, payload = load(store(data))
        assert payload[:n] == data and len(payload) % 64 == 0 and payload


def test_whole_sequences_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    media = media_table(docs)
    items = interleaved(as_pages(docs), "id", "html")
    found = {r["id"]: r["items"] for r in sequences(resolve(items, payloads(media).join(features(media), "digest"))).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for doc, text in rows:
        data, body = text.encode(), text.strip()
        got = [(x["pos"], x["kind"], x["text"], x["caption"], x["stored"] and load(bytes(x["stored"])), x["payload_sha256"]) for x in found[doc]]
        medium = (len(got) - 1, "media", None, f"{len(data)} bytes", (len(data), data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")), brute(text)[2])
        assert got == ([(0, "text", body, None, None, None)] if body else []) + [medium]


def test_sequences_of_pages_keep_the_order_of_their_html(spark, sf):
    """Against the places of the tags themselves in the table's pages."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    got = {r["id"]: r["items"] for r in sequences(interleaved(pages)).collect()}
    for page, html in pages.collect():
        shown = re.sub(r"(?is)<!--.*?-->|<(script|style|template|noscript|title)\b.*?</\1\s*>", "", html or "")
        refs = re.findall(r"(?is)<(?:img|video|audio|source|embed)\b[^>]*?\ssrc=[\"']([^\"']+)", shown)
        items = got.get(page, [])
        assert [x["ref"] for x in items if x["kind"] == "media"] == [unescape(r) for r in refs]
        words = "".join(re.sub(r"(?s)<[^>]*>", "", shown).split())
        flat = "".join("".join((x["text"] or "").split()) for x in items if x["kind"] == "text")
        captions = "".join("".join((x["caption"] or "").split()) for x in items if x["kind"] == "media" and x["caption"])
        assert sorted(unescape(words)) == sorted(flat + captions) or not refs and unescape(words) == flat
        assert [x["pos"] for x in items] == list(range(len(items)))
