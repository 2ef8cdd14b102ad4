"""What stands behind models and OCR. The mock is deterministic; others are registered by name."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from .config import DEFAULT, Config
from .functions.ranking import best_sentences, centralities
from .functions.text import difficulty, seed

#: What tells of an error worth another try.
RETRYABLE = re.compile(r"\b429\b|\b50[0-9]\b|quota|rate limit|resource exhausted|overloaded|unavailable")
#: A refusal on grounds of safety, and a model that doesn't exist.
REFUSED, UNKNOWN = re.compile(r"safety|blocked"), re.compile(r"\b404\b|not found")
#: Fixed value: what a question counts as that nobody judged.
UNJUDGED = {"is_valid": False, "quality_score": 0.5, "critique": ""}
VERDICT = StructType([StructField("is_valid", BooleanType()), StructField("quality_score", DoubleType()), StructField("critique", StringType())])
#: What a method gives for each value, if not a string; and what stands for a value without an answer, if not null.
GIVES: dict[str, tuple[DataType, pa.DataType, dict | None]] = {
    "validate": (VERDICT, pa.struct([("is_valid", pa.bool_()), ("quality_score", pa.float64()), ("critique", pa.string())]), UNJUDGED),
    "embed": (ArrayType(FloatType()), pa.list_(pa.float32()), None),
}


class Provider(Protocol):
    """Methods take and return lists, so that a partition's rows go out in batches."""

    def embed(self, texts: list[str]) -> np.ndarray: ...

    def generate(self, texts: list[str], n: int, slugs: list[str], level: str | None = None, style: str | None = None) -> list[str]: ...

    def validate(self, questions: list[str]) -> list[dict]: ...

    def summarize(self, texts: list[str]) -> list[str]: ...

    def ocr(self, files: list[bytes]) -> list[str]: ...

    def see(self, images: list[bytes], n: int) -> tuple[str, int]: ...

    def review(self, raw: str) -> tuple[str, int]: ...


class MockProvider:
    """The same answers for the same input, anywhere."""

    dim = 64

    def embed(self, texts: list[str]) -> np.ndarray:
        """Hashed byte trigrams of the lower-cased text, unit length."""
        out = np.zeros((len(texts), self.dim), np.float32)
        for k, text in enumerate(texts):
            data = np.frombuffer((text or "").lower().encode(), np.uint8).astype(np.uint64)
            if len(data) > 2:
                h = (data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]) * np.uint64(0x9E3779B97F4A7C15)
                signs = np.where(h >> np.uint64(63), 1.0, -1.0)
                out[k] = np.bincount((h >> np.uint64(32)).astype(np.int64) % self.dim, signs, self.dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def generate(self, texts: list[str], n: int, slugs: list[str], level: str | None = None, style: str | None = None) -> list[str]:
        """The questions that mock_mcqs() makes, as a model would write them."""
        hard = (level or "").strip().lower()
        found = []
        for text in texts:
            key = hashlib.sha256(text[:200].encode()).hexdigest()[:8]
            one = lambda i: {
                "question": f"[Mock] Question {i + 1} (seed {key}): What is the main idea of the given text?",  # noqa: B023
                "options": {x: f"Option {x} (mock)" for x in "ABCD"},
                "correct_option": "ABCD"[i % 4],
                "explanation": f"Mock explanation for question {i + 1}.",
                "difficulty": hard if hard in ("easy", "medium", "hard") else "medium",
                "topic_tag": (slugs or ["polity"])[i % len(slugs or ["polity"])],
            }
            found.append(json.dumps({"mcqs": [one(i) for i in range(max(1, min(25, n)))]}))
        return found

    def validate(self, questions: list[str]) -> list[dict]:
        return [{"is_valid": True, "quality_score": 0.8, "critique": "Approved (mock)."} for _ in questions]

    def summarize(self, texts: list[str]) -> list[str]:
        return [" ".join(t.split()[:12]) for t in texts]

    def ocr(self, files: list[bytes]) -> list[str]:
        return [f.decode("utf-8", "replace") for f in files]

    def see(self, images: list[bytes], n: int) -> tuple[str, int]:
        """Questions on page images, with labelled options, and the tokens used."""
        options = [{"label": x, "text": f"Option {x} (mock)"} for x in "ABCD"]
        made = [{"question": f"[Mock] Question {i + 1} on {len(images)} pages?", "options": options, "correct_option": "ABCD"[i % 4], "topic_tag": "polity"} for i in range(n)]
        return json.dumps({"questions": made}), 500 + sum(map(len, images)) // 4

    def review(self, raw: str) -> tuple[str, int]:
        return raw, 100


class ExtractiveProvider(MockProvider):
    """Summaries without a model: the two most central sentences of a text, in its order. Other methods are the mock's."""

    def summarize(self, texts: list[str]) -> list[str]:
        parts = [[x for x in (s.strip() for s in re.split(r"(?<=[.!?])\s+", t)) if x] for t in texts]
        return [" ".join(p[i] for i in best_sentences(p, c, 2)) for p, c in zip(parts, centralities(parts), strict=True)]


_REGISTRY: dict[str, Callable[[], Provider]] = {"mock": MockProvider, "extractive": ExtractiveProvider}


def register(name: str, factory: Callable[[], Provider]) -> None:
    _REGISTRY[name] = factory


def provider(name: str = "mock") -> Provider:
    """The provider of that name; unknown or unusable ones give way to the mock."""
    try:
        return _REGISTRY.get(name, MockProvider)()
    except Exception:  # noqa: BLE001  a provider without its key or library
        return MockProvider()


def maker(name: str | tuple[str, ...]) -> Callable[[], Provider]:
    """What makes the provider of that name, or the chain of these names, where it is called: on a worker, which knows nothing of the registry.

    The factory itself goes into the closure. A name that nobody registered fails here; a provider that can't be made gives way to the mock.
    """
    if not isinstance(name, str):
        chain = Chain(*name)
        return lambda: chain
    if name not in _REGISTRY:
        raise ValueError(f"no provider is registered as {name}")
    factory = _REGISTRY[name]

    def make() -> Provider:
        try:
            return factory()
        except Exception:  # noqa: BLE001  a provider without its key or library
            return MockProvider()

    return make


class Limited:
    """Calls that may take limit_s seconds each, one after the other: TimeoutError if one takes longer.

    All calls of a task share a thread. A call that is too late keeps the one it has, as a thread can't be stopped, and later calls get another; `abandoned` counts these, and once there
    are most_abandoned of them that haven't ended, further calls fail at once instead of adding to them.
    """

    def __init__(self, limit_s: float | None, most_abandoned: int = 8):
        self.limit_s, self.most, self.abandoned, self.late, self.pool = limit_s, most_abandoned, 0, [], None

    def __call__(self, call: Callable, *args):
        if self.limit_s is None:
            return call(*args)
        self.late = [f for f in self.late if not f.done()]
        if len(self.late) >= self.most:
            raise TimeoutError(f"{len(self.late)} calls that took too long haven't ended")
        self.pool = self.pool or ThreadPoolExecutor(1)
        future = self.pool.submit(call, *args)
        try:
            return future.result(self.limit_s)
        except TimeoutError:
            if not future.done():
                self.late.append(future)
                self.abandoned += 1
                self.pool.shutdown(wait=False)
                self.pool = None
            raise

    def close(self) -> None:
        if self.pool:
            self.pool.shutdown(wait=False)
            self.pool = None


class Chain:
    """Providers in turn: a call that fails with a retryable error is tried again, then goes to the next provider, which all later calls go to as well.

    Other errors go to the next provider at once, but a call that takes too long ends. A refusal is tried once more
    with what the provider's `unguarded` gives, if it has that. One chain serves one task.
    """

    def __init__(self, *names: str, tries: int = 4, wait: Callable[[int], None] = lambda attempt: time.sleep(min(60, 2 << attempt)), limit_s: float | None = None):
        self.makers, self.tries, self.wait, self.within, self.at = [maker(n) for n in names], tries, wait, Limited(limit_s), 0

    def _call(self, method: str, *args):
        error: Exception | None = None
        while self.at < len(self.makers):
            model = self.makers[self.at]()
            for attempt in range(self.tries):
                try:
                    return self.within(getattr(model, method), *args)
                except TimeoutError:
                    raise
                except Exception as e:  # noqa: BLE001  any failure of a provider
                    error, said = e, str(e).lower()
                    if REFUSED.search(said) and hasattr(model, "unguarded"):
                        try:
                            return self.within(getattr(model.unguarded(), method), *args)
                        except TimeoutError:
                            raise
                        except Exception as e:  # noqa: BLE001
                            error, said = e, str(e).lower()
                    if UNKNOWN.search(said) or not RETRYABLE.search(said):
                        break
                    if attempt + 1 < self.tries:
                        self.wait(attempt)
            self.at += 1
        self.at = len(self.makers) - 1
        raise RuntimeError("no provider answered") from error

    def __getattr__(self, method: str):
        if method.startswith("_") or method == "unguarded":
            raise AttributeError(method)
        return lambda *args: self._call(method, *args)


def answers(call: Callable, values: list, args: tuple, missing: object) -> list:
    """An answer for each value: of one call, or of one call each if that fails. Too few answers, and failures, leave the missing one."""
    try:
        got = list(call(values, *args))[: len(values)]
        return [missing if x is None else x for x in got] + [missing] * (len(values) - len(got))
    except Exception:  # noqa: BLE001  any failure of a provider
        if len(values) == 1:
            return [missing]
        return [x for v in values for x in answers(call, [v], args, missing)]


def mapped(rows: DataFrame, column: str, out: str, method: str, name: str | tuple[str, ...] = "mock", batch: int = 20, args: tuple = (), limit_s: float | None = None) -> DataFrame:
    """rows with what a provider's method gives for each value of a column: `batch` values a call, one by one if a batch fails; one provider a task.

    Null values get no call and no answer. limit_s: seconds that a call may take; one that takes longer counts as failed.
    """
    make, at = maker(name), rows.columns.index(column)
    spark_type, arrow_type, missing = GIVES.get(method, (StringType(), pa.string(), None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limited = make(), Limited(limit_s)
        call = lambda *a: limited(getattr(model, method), *a)
        for b in batches:
            values = b.column(at).to_pylist()
            asked = [k for k, v in enumerate(values) if v is not None]
            found: list = [missing] * len(values)
            for first in range(0, len(asked), batch):
                part = asked[first : first + batch]
                for k, x in zip(part, answers(call, [values[k] for k in part], args, missing), strict=True):
                    found[k] = x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, arrow_type)], [*b.schema.names, out])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, spark_type)]))


def _listed(raw: str | None, field: str) -> bool:
    body = re.sub(r"\A```[^\n]*\n?|\n?[ \t]*```[ \t]*\Z", "", (raw or "").strip())
    try:
        found = json.loads(body)
    except ValueError:
        return False
    found = found.get(field) if isinstance(found, dict) else found
    return isinstance(found, list) and any(isinstance(x, dict) for x in found)


def some_questions(raw: str | None) -> bool:
    """Whether a model's answer has questions at all."""
    return _listed(raw, "mcqs")


def some_seen(raw: str | None) -> bool:
    """The same of an answer on page images."""
    return _listed(raw, "questions")


def asked_until(rows: DataFrame, column: str, args: tuple, name: str | tuple[str, ...] = "mock", tries: int = DEFAULT.generation_attempts, batch: int = 20) -> DataFrame:
    """rows with `raw`, the first of at most `tries` answers of generate that has questions (else the last), and `attempts`."""
    make, at = maker(name), rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            values = b.column(at).to_pylist()
            raw: list[str | None] = [None] * len(values)
            attempts = [0] * len(values)
            for _ in range(tries):
                todo = [k for k, v in enumerate(values) if v is not None and not some_questions(raw[k])]
                for first in range(0, len(todo), batch):
                    part = todo[first : first + batch]
                    for k, x in zip(part, answers(model.generate, [values[k] for k in part], args, None), strict=True):
                        raw[k], attempts[k] = x, attempts[k] + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.string()), pa.array(attempts, pa.int64())], [*b.schema.names, "raw", "attempts"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("raw", StringType()), StructField("attempts", LongType())]))


def embedded(rows: DataFrame, column: str, name: str | tuple[str, ...] = "mock", limit_s: float | None = None) -> DataFrame:
    """rows with `embedding`; null where the provider gives none, so that callers can fall back on spread chunks."""
    return mapped(rows, column, "embedding", "embed", name, 64, limit_s=limit_s)


def mock_mcqs(rows: DataFrame, text: Column, topics: list[str], n: int, level: str | None = None, *keep: str) -> DataFrame:
    """(kept columns, cand_ix, question, options, correct_option, explanation, difficulty, topic_tag): the mock's questions, all in the JVM."""
    count = max(1, min(25, n))  # fixed values: the bounds, and the texts below
    i = F.col("cand_ix")
    slugs = F.array(*map(F.lit, topics or ["polity"]))
    number = (i + 1).cast("string")
    each = rows.select(*keep, seed(text).alias("seed_"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("cand_ix"))
    return each.select(
        *keep,
        "cand_ix",
        F.concat(F.lit("[Mock] Question "), number, F.lit(" (seed "), F.col("seed_"), F.lit("): What is the main idea of the given text?")).alias("question"),
        F.create_map(*[x for k in "ABCD" for x in (F.lit(k), F.lit(f"Option {k} (mock)"))]).alias("options"),
        F.array(*map(F.lit, "ABCD"))[(i % 4).cast("int")].alias("correct_option"),
        F.concat(F.lit("Mock explanation for question "), number, F.lit(".")).alias("explanation"),
        difficulty(F.lit(level)).alias("difficulty"),
        slugs[(i % F.size(slugs)).cast("int")].alias("topic_tag"),
    )


def mock_tokens(text: Column) -> Column:
    return F.struct((F.lit(500) + F.floor(F.length(text) / 4)).cast("long").alias("input"), F.lit(800).cast("long").alias("output"))


def candidates_wanted(target: int, config: Config = DEFAULT) -> int:
    return min(target + config.extra_candidates, config.max_target)
