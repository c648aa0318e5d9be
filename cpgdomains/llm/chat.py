"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns of a conversation are read in the order (turn, role, text). Every turn gives three segments: header,
escaped text, end; each carries a loss flag. Control strings inside texts are escaped, so that a reader finds
turns by their markers alone and gets every text back. One shuffle by conversation; a task streams its
conversations in order and holds one turn at a time, so a conversation of any length needs no memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

START, END = "<start>", "<end>"


@dataclass(frozen=True)
class Template:
    """Markers, escapes, the roles whose text bears loss, and the allowed steps from each state.

    The first escape is the escape character itself; a step to END means a conversation may stop there.
    """

    head: str = "### "
    colon: str = ": "
    end: str = " </turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"), (": ", "\\c"))
    loss: frozenset[str] = frozenset({"assistant"})
    steps: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            START: frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool", END}),
            "tool": frozenset({"assistant"}),
        }
    )

    def escape(self, text: str) -> str:
        for plain, safe in self.escapes:
            text = text.replace(plain, safe)
        return text

    def unescape(self, text: str) -> str:
        back = {safe[1]: plain for plain, safe in self.escapes}
        return re.sub(r"\\(.)", lambda m: back[m[1]], text, flags=re.S) if "\\" in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(self.head + self.escape(role) + self.colon, False), (self.escape(text), role in self.loss), (self.end, False)]


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[n].to_pylist() for n in names), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_SEGMENT = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("part", pa.int32()), ("segment", pa.string()), ("loss", pa.bool_()), ("step_ok", pa.bool_()), ("may_end", pa.bool_())])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def _format(template: Template, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        at, state, n = object(), START, 0
        for conv, role, text in _rows(batches, "conv_id", "role", "text"):
            if conv != at:
                at, state, n = conv, START, 0
            ok = role in template.steps.get(state, ())
            may_end = END in template.steps.get(role, ())
            for part, (segment, loss) in enumerate(template.segments(role, text)):
                yield conv, n, part, segment, loss, ok, may_end
            state, n = role, n + 1

    return _batches(rows(), _SEGMENT)


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of ``turns(conv_id, turn, role, text)``: conv_id, turn_no, part (0 header, 1 text, 2 end), segment, loss, step_ok, may_end.

    Rows come partitioned by conversation and in order, so that their concatenation is the formatted text.
    A conversation that breaks the state machine is formatted all the same; ``step_ok`` is false at each turn
    that the state before it doesn't allow. Null role or text: empty. Null turn: first. Rows with equal turns
    go by role, then text; repeated rows stay. Rows without conv_id form one conversation. Empty table: no rows.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(partial(_format, template), "conv_id long, turn_no long, part int, segment string, loss boolean, step_ok boolean, may_end boolean")


def _digest(template: Template, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read formatted text and loss flags back, turn by turn as end markers come."""

    def rows() -> Iterator[tuple]:
        at, seen = None, False
        for conv, segment, loss, ok, may_end in _rows(batches, "conv_id", "segment", "loss", "step_ok", "may_end"):
            if not seen or conv != at:
                if seen:
                    yield at, n, turns.hexdigest(), masked, lost.hexdigest(), chars, valid and ended
                at, seen, n, masked, chars, valid, ended, tail = conv, True, 0, 0, 0, True, False, ""
                turns, lost = hashlib.sha256(), hashlib.sha256()
            chars += len(segment)
            valid, ended = valid and ok, may_end
            if loss:
                plain = template.unescape(segment)
                masked += len(plain)
                lost.update(plain.encode())
            tail += segment
            while (stop := tail.find(template.end)) >= 0:
                turn, tail = tail[:stop], tail[stop + len(template.end) :]
                role, text = turn.removeprefix(template.head).split(template.colon, 1)
                turns.update(f"{template.unescape(role)}\n{template.unescape(text)}\n".encode())
                n += 1
        if seen:
            yield at, n, turns.hexdigest(), masked, lost.hexdigest(), chars, valid and ended

    return _batches(rows(), _DIGEST)


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation of ``format_chats``' output, from its text and loss flags: counts and digests of turns and of loss-bearing text."""
    return segments.mapInArrow(partial(_digest, template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
