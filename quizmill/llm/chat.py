"""Conversations as training examples: each assistant turn with all turns before it as context, and only that reply trainable.

A turn is `<|im_start|>role` newline text `<|im_end|>` newline. Inside roles and texts every `<`, backslashes, `|` gets one
more backslash, so no control string stands in them, and taking one away restores them. Every example repeats its context in full, so
the output grows with the square of a conversation's length, and a task holds a conversation. A caller may set a limit instead: once a
conversation has more characters, each turn is a row of its own whose context is all earlier rows of it (`refers`); `rebuilt` makes full examples of these.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import table, written

#: Fixed values of the template.
START, STOP = "<|im_start|>", "<|im_end|>\n"

_IN, _OUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _IN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _OUT.sub(r"<\1|", text)


def _role_in(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_out(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and ends in it."""
    head, body = f"{START}{_role_in(role)}\n", escape(text)
    return head + body + STOP, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    turns = []
    for part in text.split(STOP)[:-1]:
        role, _, body = part.removeprefix(START).partition("\n")
        turns.append((_role_out(role), unescape(body)))
    return turns


class Expander:
    """Rows of one conversation, turn by turn."""

    def __init__(self, conv: int | None, limit: int | None = None):
        self.conv, self.limit, self.example, self.prefix, self.pending, self.refers = conv, limit, 0, "", False, False

    def _row(self, text: str, span: tuple[int, int] | None) -> tuple:
        self.example += 1
        return (self.conv, self.example - 1, self.refers, text, *(span or (None, None)))

    def add(self, role: str, text: str) -> Iterator[tuple]:
        turn, a, b = turn_text(role, text)
        if self.limit is not None and not self.refers and len(self.prefix) + len(turn) > self.limit:
            if self.pending:
                yield from self.end()
            self.refers, self.prefix = True, ""
        if self.refers:
            yield self._row(turn, (a, b) if role == "assistant" else None)
            return
        at = len(self.prefix)
        self.prefix += turn
        self.pending = role != "assistant"
        if not self.pending:
            yield self._row(self.prefix, (at + a, at + b))

    def end(self) -> Iterator[tuple]:
        """Turns after the last reply stand in a row without a trainable part."""
        if self.pending:
            self.pending = False
            yield self._row(self.prefix, None)


SCHEMA = "conv_id long, example long, refers boolean, text string, loss_from long, loss_to long"
_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
_NAMES = ["conv_id", "example", "refers", "text", "loss_from", "loss_to"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def expand(turns: DataFrame, limit: int | None = None) -> DataFrame:
    """(conv_id, example, refers, text, loss_from, loss_to) of conversations(conv_id, turn, role, text).

    Turns are taken by turn, then role and text (null first); repeated rows stay. Null roles and texts are empty, texts of any length are whole in every example, null conversation ids are a
    conversation of their own. Columns not named are ignored. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Expander | None = None
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if now is None or now.conv != conv:
                    rows += now.end() if now else ()
                    now = Expander(conv, limit)
                for row in now.add(role or "", text or ""):
                    rows.append(row)
                    size += len(row[3])
                if size > 1 << 22:
                    yield _batch(rows)
                    rows, size = [], 0
        rows += now.end() if now else ()
        yield _batch(rows)

    order = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    order = order.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return order.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def rebuilt(examples: DataFrame) -> DataFrame:
    """Rows of `expand` without a limit, from rows of it with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Expander | None = None
        full = ""

        def turns(text: str) -> Iterator[pa.RecordBatch]:
            for turn in parse(text):
                for row in now.add(*turn):
                    yield _batch([row])

        def close() -> Iterator[pa.RecordBatch]:
            if now:
                yield from turns(full)
                yield _batch(list(now.end()))

        for b in batches:
            for conv, refers, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if now is None or now.conv != conv:
                    yield from close()
                    now, full = Expander(conv), ""
                if refers:
                    yield from turns(full)
                    yield from turns(text)
                full = "" if refers else text
        yield from close()

    order = examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return order.select("conv_id", "refers", "text").mapInArrow(run, SCHEMA)


class Reader:
    """Digests of one conversation from its rows in order; holds the longest full example only."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.full = ""

    def add(self, refers: bool, text: str, a: int | None, b: int | None) -> None:
        if a is not None:
            reply = unescape(text[a:b])
            self.loss_chars += len(reply)
            self.loss.update(reply.encode())
        if refers:
            self._read(self.full)
            self.full = ""
            self._read(text)
        else:
            self.full = text

    def _read(self, text: str) -> None:
        self.chars += len(text)
        for role, body in parse(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{body}\n".encode())

    def row(self) -> tuple:
        self._read(self.full)
        return (self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def summaries(examples: DataFrame) -> DataFrame:
    """What the examples hold, read back: a row for each conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Reader | None = None
        rows: list[tuple] = []
        for b in batches:
            for conv, refers, text, a, z in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        rows.append(now.row())
                    now = Reader(conv)
                now.add(refers, text, a, z)
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if now:
            rows.append(now.row())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, types, strict=True)], names)

    order = examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return order.select("conv_id", "refers", "text", "loss_from", "loss_to").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


HARD = f"<|im_end|>{START}assistant ok"


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, 0, "user", HARD), (-1, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return summaries(written(expand(turns.unionByName(hard)), "examples"))


OP8_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
