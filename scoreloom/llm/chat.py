"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context and only its reply is
trainable. A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``; inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so no text can open or close a turn, and both are undone on reading.

Conversations are streamed in turn order. Every example's whole text is written out literally, however long, so the
output grows with the square of a conversation's length. Only a caller that gives ``max_inline_chars`` gets
rows with ``continues = true`` beyond it, which hold what follows the row before; reading rows in order gives
the whole again. Turns after the last reply are in a last such row without a loss span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.storage import map_batches

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TARGET = "assistant"
EXAMPLES = "conv_id long, example long, continues boolean, text string, loss_start long, loss_end long"
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_FLUSH = 1 << 22
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _expand(max_inline_chars: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting = 0
        current: object = run  # no conversation yet
        context, length, since, example, inline = [], 0, [], 0, True
        for conv, role, text in chain(_rows(batches), [(run, "", "")]):
            if conv is run or conv != current:
                if since:
                    out.append((current, example, True, "".join(since), None, None))
                current, context, length, since, example, inline = conv, [], 0, [], 0, True
            if conv is run:
                break
            head, body = OPEN + escape_role(role) + "\n", escape(text)
            turn = head + body + CLOSE
            inline = inline and (max_inline_chars is None or length + len(turn) <= max_inline_chars)
            if inline:
                context.append(turn)
            else:
                context = []
            length += len(turn)
            since.append(turn)
            if role == TARGET:
                whole = "".join(context if inline else since)
                end = len(whole) - len(CLOSE)
                out.append((conv, example, not inline, whole, end - len(body), end))
                waiting += len(whole)
                since, example = [], example + 1
            if waiting > _FLUSH:
                yield _batch(out, EXAMPLES)
                out, waiting = [], 0
        if out:
            yield _batch(out, EXAMPLES)

    return run


def prefix_target_examples(conversations: DataFrame, max_inline_chars: int | None = None) -> DataFrame:
    """``(conv_id, example, continues, text, loss_start, loss_end)`` of ``conversations(conv_id, turn, role, text)``.

    Turns go by ``turn`` (null last), then role, then text; repeated rows are repeated turns. Null roles and
    texts are empty. Null conv_ids form one conversation. Other columns are ignored. ``loss_start`` and
    ``loss_end`` are code points in ``text``; a row without a reply has null ones. One conversation's turns are
    read by one task, which holds the text so far; a text of 2^31 bytes does not fit a row and fails. With
    ``max_inline_chars`` it holds at most that much and the turns since the last reply.
    """
    base = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = base.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return map_batches(ordered.select("conv_id", "role", "text"), _expand(max_inline_chars), EXAMPLES)


class _Reader:
    """Digests of one conversation, fed with its rows in order."""

    def __init__(self, conv):
        self.conv, self.n_turns, self.loss_chars, self.formatted = conv, 0, 0, 0
        self.turns, self.loss, self.whole = hashlib.sha256(), hashlib.sha256(), ""

    def _count(self, formatted: str) -> None:
        for role, text in parse(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())

    def feed(self, continues: bool, text: str, start: int | None, end: int | None) -> None:
        self.formatted += len(text)
        if start is not None:
            reply = unescape(text[start:end])
            self.loss_chars += len(reply)
            self.loss.update(reply.encode())
        if not continues:
            self.whole = text  # holds all turns of the examples before it
            return
        self._count(self.whole)
        self.whole = ""
        self._count(text)

    def row(self) -> tuple:
        self._count(self.whole)
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    reader = None
    for conv, _, continues, text, start, end in _rows(batches):
        if reader is None or reader.conv != conv:
            if reader is not None:
                out.append(reader.row())
            reader = _Reader(conv)
        reader.feed(continues, text, start, end)
        if len(out) >= 4096:
            yield _batch(out, _DIGEST)
            out = []
    if reader is not None:
        out.append(reader.row())
    yield _batch(out, _DIGEST)


def digest_examples(examples: DataFrame, in_order: bool = False) -> DataFrame:
    """Read examples back: ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, per conversation its
    turns, their digest, and the digest of all text under the loss mask. ``formatted_chars`` counts the characters of the
    rows as written.

    ``in_order``: each conversation's rows come one after another in one partition, as ``prefix_target_examples`` makes them, and
    are read where they are; else they are dealt out and sorted first. A null conv_id is a conversation; empty texts count
    for nothing; very long ones are held one at a time; rows that repeat an example are read again; an empty table gives
    an empty result; other columns are ignored.
    """
    columns = ["conv_id", "example", "continues", "text", "loss_start", "loss_end"]
    ordered = examples.select(*columns)
    if not in_order:
        ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return map_batches(ordered, _read, _DIGEST)
