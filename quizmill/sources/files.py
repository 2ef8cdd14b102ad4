"""Documents from files: binary files, text by page through an OCR provider, and extraction results."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..config import DEFAULT, Config
from ..functions.text import clean
from ..providers import maker


def pdf_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of the PDF files under a path, once or as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    if stream:
        return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)


_HEAD = re.compile(rb"(?<![0-9])([0-9]+)\s+([0-9]+)\s+obj\b")
_NEXT = re.compile(rb"\bstream\r?\n|\bendobj\b")
_LENGTH = re.compile(rb"/Length\s+([0-9]+)(?![0-9])(?!\s+[0-9]+\s+R)")
_REFERENCE = re.compile(rb"(?<![0-9])([0-9]+)\s+[0-9]+\s+R\b")
_PAGE, _TREE = re.compile(rb"/Type\s*/Page(?![A-Za-z])"), re.compile(rb"/Type\s*/Pages(?![A-Za-z])")


def _scanned(data: bytes) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(number, dictionary, stream or None) of each object written out in a PDF, in order. A stream is as long as it says, or up to the next end mark."""
    at = 0
    while head := _HEAD.search(data, at):
        end = _NEXT.search(data, head.end())
        if end is None:
            return
        body = data[head.end() : end.start()]
        if end[0] == b"endobj":
            yield int(head[1]), body, None
            at = end.end()
            continue
        told = _LENGTH.search(body)
        stop = end.end() + int(told[1]) if told else -1
        if stop < 0 or not data[stop : stop + 32].lstrip().startswith(b"endstream"):
            stop = data.find(b"endstream", end.end())
        if stop < 0:
            return
        yield int(head[1]), body, data[end.end() : stop]
        at = stop


def pdf_streams(data: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """A PDF's objects by number: dictionary and stream, those in compressed object streams too; of a repeated number the last stands."""
    found: dict[int, tuple[bytes, bytes | None]] = {}
    for number, head, stream in _scanned(data):
        found[number] = head, stream
        if stream is not None and re.search(rb"/Type\s*/ObjStm\b", head):
            first, n = (int(re.search(rb"/%s\s+([0-9]+)" % k, head)[1]) for k in (b"First", b"N"))
            plain = zlib.decompressobj().decompress(stream) if b"/FlateDecode" in head else stream
            table = [int(x) for x in plain[:first].split()[: 2 * n]]
            starts = [first + x for x in table[1::2]]
            for k, (inner, at) in enumerate(zip(table[::2], starts, strict=True)):
                found[inner] = plain[at : starts[k + 1] if k + 1 < n else None], None
    return found


def pdf_objects(data: bytes) -> dict[int, bytes]:
    """The dictionaries of pdf_streams."""
    return {number: head for number, (head, _) in pdf_streams(data).items()}


def pdf_pages(data: bytes | None) -> list[int] | None:
    """Numbers of the page objects in order, by the page tree; null for what isn't a readable PDF."""
    try:
        if b"%PDF-" not in (data or b"")[:1024]:
            return None
        objects = pdf_objects(data)
        trees = {k for k, v in objects.items() if _TREE.search(v)}
        kids = {k: [int(x) for x in re.findall(rb"([0-9]+)\s+[0-9]+\s+R", (re.search(rb"/Kids\s*\[(.*?)\]", objects[k], re.S) or [b"", b""])[1])] for k in trees}
        roots = [int(m[1]) for v in objects.values() if re.search(rb"/Type\s*/Catalog\b", v) for m in [re.search(rb"/Pages\s+([0-9]+)\s+[0-9]+\s+R", v)] if m]
        order, seen, todo = [], set(), [r for r in roots[-1:] if r in trees]
        while todo:
            k = todo.pop()
            if k in seen:
                continue
            seen.add(k)
            if k in trees:
                todo += reversed(kids[k])
            elif _PAGE.search(objects.get(k, b"")):
                order.append(k)
        # without a tree that leads to them, the page objects themselves
        return order or sorted(k for k, v in objects.items() if _PAGE.search(v)) or None
    except (zlib.error, ValueError, TypeError, IndexError):
        return None


def _value(head: bytes, key: bytes) -> bytes | None:
    """The value of a key in a dictionary, as it is written: a name, number, reference, array or dictionary."""
    found = re.search(rb"/%s(?![A-Za-z])\s*" % key, head)
    if not found:
        return None
    rest = head[found.end() :]
    simple = re.match(rb"[0-9]+\s+[0-9]+\s+R\b|/[^\s/<>\[\]()]+|[-+.0-9]+", rest)
    if simple:
        return simple[0]
    depth = 0
    for mark in re.finditer(rb"<<|>>|\[|\]", rest):
        depth += 1 if mark[0] in (b"<<", b"[") else -1
        if depth <= 0:
            return rest[: mark.end()]
    return None


#: What a page takes from the nodes above it.
INHERITED = [b"Resources", b"MediaBox", b"CropBox", b"Rotate"]


def pdf_part(data: bytes, pages: list[int]) -> bytes:
    """A PDF of these of its page objects alone: they, what they refer to, and a new catalog and page tree. Its size follows the pages.

    What a page inherits from the nodes above it is written into it. Other pages, trees and catalogs that a page refers to (as links do) are left out: a reference to them is null. An
    encrypted file can't be cut so; it is given whole, with an update at its end that leads to these pages only.
    """
    held = pdf_streams(data)
    top = max(held) + 1
    if re.search(rb"/Encrypt\s+[0-9]+\s+[0-9]+\s+R", data):
        return _updated(data, pages, top)
    kept: dict[int, tuple[bytes, bytes | None]] = {}
    for number in pages:
        head, more, above = held[number][0], b"", _value(held[number][0], b"Parent")
        for _ in range(len(held)):
            node = held.get(int(above.split()[0]), (b"", None))[0] if above else b""
            if not node:
                break
            more += b"".join(b"/%s %s" % (k, v) for k in INHERITED if _value(head + more, k) is None and (v := _value(node, k)) is not None)
            above = _value(node, b"Parent")
        own = re.sub(rb"/Parent\s+[0-9]+\s+[0-9]+\s+R", b"", head).strip()
        kept[number] = own[: own.rindex(b">>")] + more + b"/Parent %d 0 R>>" % (top + 1), None
    todo = [x for head, _ in kept.values() for x in map(int, _REFERENCE.findall(head))]
    while todo:
        number = todo.pop()
        if number in kept or number not in held or _PAGE.search(held[number][0]) or _TREE.search(held[number][0]) or re.search(rb"/Type\s*/Catalog\b", held[number][0]):
            continue
        kept[number] = held[number]
        todo += map(int, _REFERENCE.findall(held[number][0]))
    kept[top] = b"<</Type/Catalog/Pages %d 0 R>>" % (top + 1), None
    kept[top + 1] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(pages), b" ".join(b"%d 0 R" % p for p in pages)), None
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for number, (head, stream) in sorted(kept.items()):
        places[number] = len(out)
        out += b"%d 0 obj\n%s%s\nendobj\n" % (number, head.strip(), b"" if stream is None else b"\nstream\n%s\nendstream" % stream)
    table = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in sorted(places.items()))
    return bytes(out + b"trailer\n<</Size %d/Root %d 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (top + 2, top, table))


def _updated(data: bytes, pages: list[int], top: int) -> bytes:
    """data with a new catalog and page tree at its end, all other objects as they were."""
    former = re.findall(rb"startxref\s+([0-9]+)", data)
    rest = re.findall(rb"/(?:Encrypt\s+[0-9]+\s+[0-9]+\s+R|ID\s*\[[^\]]*\])", data)
    out = bytearray(data if data.endswith(b"\n") else data + b"\n")
    new = {top: b"<</Type/Catalog/Pages %d 0 R>>" % (top + 1), top + 1: b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(pages), b" ".join(b"%d 0 R" % p for p in pages))}
    places = {}
    for number, body in new.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    table = len(out)
    out += b"xref\n%d 2\n%010d 00000 n \n%010d 00000 n \n" % (top, places[top], places[top + 1])
    out += b"trailer\n<</Size %d/Root %d 0 R%s%s>>\nstartxref\n%d\n%%%%EOF\n" % (top + 2, top, b"/Prev %s" % former[-1] if former else b"", b"".join(dict.fromkeys(rest)), table)
    return bytes(out)


def page_counts(files: DataFrame, column: str = "content", out: str = "pages") -> DataFrame:
    """files with their numbers of pages; null for what isn't a readable PDF."""
    at = files.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [pages and len(pages) for pages in (pdf_pages(x) for x in b.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int32())], [*b.schema.names, out])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField(out, IntegerType())]))


def ocr_calls(files: DataFrame, key: str, config: Config = DEFAULT, column: str = "content") -> DataFrame:
    """(key, digest, pages, call, part): what goes to OCR in one call each, up to pages_per_ocr_call pages of a PDF file; one row with null call and part for what can't be read.

    digest tells the content's files apart where keys are repeated.
    """
    size = config.pages_per_ocr_call
    names = [key, "digest", "pages", "call", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(len(b)):
                data = b.column(2)[at].as_py()
                pages = pdf_pages(data)
                parts = [None] if not pages else [data] if len(pages) <= size else (pdf_part(data, pages[k : k + size]) for k in range(0, len(pages), size))
                for call, part in enumerate(parts):  # one at a time: a file's parts are never all there
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1), b.column(1).slice(at, 1), pa.array([pages and len(pages)], pa.int32()), pa.array([call if part is not None else None], pa.int32()), pa.array([part], pa.binary())], names)

    made = StructType.fromDDL("digest string, pages int, call int, part binary")
    return files.select(key, F.sha2(F.coalesce(column, F.lit(b"")), 256).alias("digest"), column).distinct().mapInArrow(run, StructType([files.schema[key], *made.fields]))


def ocr_texts(files: DataFrame, key: str, name: str | tuple[str, ...] = "mock", config: Config = DEFAULT, column: str = "content") -> DataFrame:
    """(key, pages, text, error) of whole PDF files: one call for up to pages_per_ocr_call pages, else one for each such part of the file.

    Parts of a file go to different tasks, and their texts come together in order. Blank results are dropped, the others joined by line ends. Unreadable files have null pages; a
    file whose calls fail gets the first failed call's error, its first characters, and no text. Equal files of a key give one row.
    """
    make, limit = maker(name), config.error_chars

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            texts, errors = [], []
            for part in b.column(b.num_columns - 1).to_pylist():
                text = error = None
                if part is not None:
                    try:
                        text = "\n".join(t for t in model.ocr([part]) if t)
                    except Exception as e:  # noqa: BLE001  any failure of a provider
                        error = str(e)[:limit]
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*b.schema.names[:-1], "text", "error"])

    calls = ocr_calls(files, key, config, column)
    told = StructType([*calls.schema.fields[:-1], StructField("text", StringType()), StructField("error", StringType())])
    # dealt anew, so that a long file's calls aren't one task's; by a number, as Catalyst would join tasks of few bytes, whatever their calls take
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    read_ = calls.repartition(tasks, F.xxhash64("digest", "call")).mapInArrow(read, told)
    parts = F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("call", "text"))))
    per = read_.groupBy(key, "digest", "pages").agg(parts.alias("parts"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("call"))).alias("error"))
    text = F.when(F.col("pages").isNotNull() & F.col("error").isNull(), F.array_join(F.transform("parts", lambda x: x["text"]), "\n"))
    return per.select(key, "pages", text.alias("text"), "error")


def located(paths: DataFrame, files: DataFrame, base: str, column: str = "path") -> DataFrame:
    """paths with `located`: the path itself if it is absolute and among files(path), else the one under base if that is; null if neither."""
    given = F.col(column)
    full = F.when(F.startswith(given, F.lit("/")), given).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), given))
    there = files.select(F.regexp_replace("path", "^file:/*", "/").alias("located")).distinct()
    return paths.withColumn("full_", full).join(there, F.col("full_") == F.col("located"), "left").drop("full_")


def page_ranges(pages: Column, config: Config = DEFAULT) -> Column:
    """array<struct<first, last>>: what goes to OCR in one call each."""
    size = config.pages_per_ocr_call
    return F.when(pages > 0, F.transform(F.sequence(F.lit(0), pages - 1, F.lit(size)), lambda s: F.struct(s.alias("first"), F.least(s + size - 1, pages - 1).alias("last")))).otherwise(F.expr("cast(array() as array<struct<first:int,last:int>>)"))


def page_texts(pages: DataFrame, key: str, name: str | tuple[str, ...] = "mock", config: Config = DEFAULT) -> DataFrame:
    """(key, text) of pages(key, page, content): OCR in groups of neighbouring pages, blank results dropped, joined in order."""

    make = maker(name)

    def run(batches):
        ocr = make().ocr
        for b in batches:
            b["text"] = ["\n".join(t for t in ocr([bytes(c) for c in group]) if t) for group in b["contents"]]
            yield b[[key, "call", "text"]]

    calls = pages.groupBy(key, F.floor(F.col("page") / config.pages_per_ocr_call).alias("call")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "content"))), lambda x: x["content"]).alias("contents"))
    texts = calls.mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, call long, text string").where("text <> ''")
    return texts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call", "text"))), lambda x: x["text"]), "\n").alias("text"))


def extraction(text: Column, pages: Column, found: Column, error: Column, config: Config = DEFAULT) -> Column:
    """The result of an extraction: text, is_valid, error_message, page_count, used_ocr_pages, failed_pages."""
    cleaned = clean(text, config)
    short = F.length(cleaned) < config.min_extraction_chars
    # fixed values
    fault = F.when(~found, "PDF file not found.").when(pages.isNull(), "PDF could not be read").when(error.isNotNull(), F.concat(F.lit("Document AI extraction failed: "), error)).when(short, "Extracted text too short or empty")
    none = F.array().cast("array<int>")
    return F.struct(
        F.when(fault.isNull(), cleaned).otherwise("").alias("text"),
        fault.isNull().alias("is_valid"),
        fault.alias("error_message"),
        F.when(found, F.coalesce(pages, F.lit(0))).otherwise(0).cast("int").alias("page_count"),
        none.alias("used_ocr_pages"),
        none.alias("failed_pages"),
    )


def paper_text(pages: DataFrame, key: str) -> DataFrame:
    """(key, text) of pages(key, page, text): trimmed pages that aren't blank, in order."""
    kept = pages.select(key, "page", F.trim("text").alias("text")).where("text <> ''")
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
