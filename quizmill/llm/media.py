"""Interleaved documents: ordered texts and media references from HTML, with payloads resolved by digest.

A page's sequence keeps the place of each text and each reference, with captions beside their media. Payloads live in a media
table under the SHA-256 of their stored form; copies are folded by digest before they are joined to references. References can be
joined to the payloads themselves (`payloads`) or, far smaller, to what is computed from these (`features`).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import sliced, table, written

ROW = 64
SCHEME = "media:sha256:"
#: Elements whose text isn't content, those that hold a medium, and those that don't end a text.
SILENT, MEDIA = {"script", "style", "template", "noscript", "title"}, {"img", "video", "audio", "source", "embed"}
INLINE = {"a", "abbr", "b", "bdi", "cite", "code", "em", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u", "wbr"}


class SequenceParser(HTMLParser):
    """Items (kind, text, ref, caption) in page order. kind: text or media."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list[str | None]] = []
        self.text: list[str] = []
        self.silent = 0
        self.figure: int | None = None
        self.caption: list[str] | None = None

    def _flush(self) -> None:
        text = "".join(self.text).strip()
        self.text = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag == "figcaption":
            self._flush()
            self.caption = []
        elif tag == "figure":
            self._flush()
            self.figure = len(self.items)
        elif tag in MEDIA:
            given = dict(attrs)
            if given.get("src"):
                self._flush()
                self.items.append(["media", None, given["src"], given.get("alt") or given.get("title")])
        elif tag not in INLINE:
            self._flush()

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            words, self.caption = "".join(self.caption).strip(), None
            held = [x for x in self.items[self.figure if self.figure is not None else len(self.items) :] if x[0] == "media"]
            for x in held:
                x[3] = words
            if not held and words:
                self.items.append(["text", words, None, None])
        elif tag == "figure":
            self._flush()
            self.figure = None
        elif tag not in INLINE and tag not in MEDIA:
            self._flush()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)

    def sequence(self, html: str | None) -> list[list[str | None]]:
        self.feed(html or "")
        self.close()
        if self.caption is not None:  # a caption that doesn't end
            self.handle_endtag("figcaption")
        self._flush()
        return self.items


ITEMS = "pos int, kind string, text string, ref string, caption string"


def interleaved(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, kind, text, ref, caption): the items of each page in order; null and empty pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [(i, k, *item) for i, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, item in enumerate(SequenceParser().sequence(html))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), *[pa.string()] * 4], strict=True)], ["id", "pos", "kind", "text", "ref", "caption"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id long, {ITEMS}")


def store(data: bytes) -> bytes:
    """A text's bytes as a grey raster, 64 samples a row, padded with 0; a comment keeps the length without the padding."""
    rows = max(1, -(-len(data) // ROW))
    return b"P5\n# bytes %d\n%d %d\n255\n" % (len(data), ROW, rows) + data.ljust(rows * ROW, b"\0")


_HEAD = re.compile(rb"P5\n# bytes (\d+)\n(\d+) (\d+)\n255\n")


def load(stored: bytes) -> tuple[int, bytes]:
    """Unpadded length and samples."""
    m = _HEAD.match(stored)
    if not m or len(stored) - m.end() != int(m[2]) * int(m[3]):
        raise ValueError("not a raster of this format")
    return int(m[1]), stored[m.end() :]


def feature(payload: bytes) -> str:
    """Mean, deviation and an 8 x 8 grid of the raster: a bit says whether a cell's mean is above the raster's."""
    raster = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    rows = np.linspace(0, len(raster), 9).astype(int)
    cells = np.array([raster[a : max(b, a + 1)].sum(axis=0, dtype=np.int64).reshape(8, 8).sum(axis=1) / (8 * len(raster[a : max(b, a + 1)])) for a, b in zip(np.minimum(rows[:-1], len(raster) - 1), rows[1:], strict=True)])
    bits = np.packbits(cells > raster.mean()).tobytes().hex()
    return f"{raster.mean():.3f}:{raster.std():.3f}:{bits}"


def media_table(payloads: DataFrame, text_col: str = "text") -> DataFrame:
    """The written (digest, stored), copies within a slice of a batch once; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            held = {hashlib.sha256(s).hexdigest(): s for s in (store((t or "").encode()) for t in b.column(0).to_pylist())}
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.binary())], ["digest", "stored"])

    return written(payloads.select(F.col(text_col)).mapInArrow(run, "digest string, stored binary"), "media")


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """A row for each digest, computed from the stored bytes as read back; copies in several files are folded."""
    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for digest, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, payload = load(stored)
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 8, types, strict=True)], names)

    made = media.mapInArrow(run, f"digest string, {FEATURES}")
    return made.groupBy("digest").agg(*[F.first(c).alias(c) for c in names[1:]])


def payloads(media: DataFrame) -> DataFrame:
    """(digest, stored): each stored form once."""
    return media.groupBy("digest").agg(F.first("stored").alias("stored"))


def resolve(items: DataFrame, found: DataFrame) -> DataFrame:
    """items with the columns that found(digest, ...) has for the media which their references name by digest; other items and unknown digests have nulls."""
    ref = F.when(F.startswith(F.col("ref"), F.lit(SCHEME)), F.substring("ref", len(SCHEME) + 1, 64))
    return items.withColumn("digest", ref).join(found, "digest", "left")


def sequences(items: DataFrame) -> DataFrame:
    """(id, items): a page's items as one ordered array of structs, references with whatever was resolved for them."""
    held = F.struct("pos", *[c for c in items.columns if c not in ("id", "pos")])
    return items.groupBy("id").agg(F.array_sort(F.collect_list(held), lambda a, b: a["pos"] - b["pos"]).alias("items"))


def as_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, html): each text's page, which shows the text and, in a figure, the raster of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            html = []
            for text in b.column(1).to_pylist():
                data = (text or "").encode()
                digest = hashlib.sha256(store(data)).hexdigest()
                html.append(f'<article><p>{escape(text or "")}</p><figure><img src="{SCHEME}{digest}"><figcaption>{len(data)} bytes</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(html, pa.string())], ["id", "html"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, html string")


def documents_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pos, caption) for every row.

    pos and caption are those of the medium in its document's page. Null and empty texts are 64 zero bytes; texts may be of any length. Equal texts have equal values; repeated and null ids give a row each. Columns not named are
    ignored. No rows: no rows.
    """
    items = interleaved(as_pages(docs, id_col, text_col), "id", "html").where("kind = 'media'")
    out = resolve(items.select("id", "pos", "ref", "caption"), written(features(media_table(docs, text_col)), "features"))  # a table: Catalyst can split a digest that many share
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")


def op10_media(spark, sf_dir: str) -> DataFrame:
    return documents_as_media(table(spark, sf_dir, "documents"))
