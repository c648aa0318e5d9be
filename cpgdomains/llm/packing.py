"""Vector bin packing of token sequences: limits on tokens, segments and loss-bearing tokens at once.

Each task packs the rows it reads, without a shuffle. Of the open bins with room in every dimension, a piece goes to
the one whose remaining capacities have the largest dot product with its needs, each divided by its limit. When none has
room and the open bins are as many as allowed, the fullest one is topped up by cutting the piece. At the end of a
task the open bins' pieces are cut to full sequences, and what is left to sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import encoder


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 128
    loss: int = 4096
    open_bins: int = 32


@dataclass
class Piece:
    """Tokens start to start + length of a document; the first ``prompt`` tokens of a document bear no loss."""

    doc: int
    start: int
    ids: np.ndarray
    total: int
    prompt: int

    def loss(self, length: int | None = None) -> int:
        stop = self.start + (len(self.ids) if length is None else length)
        return max(0, stop - max(self.start, self.prompt))

    def cut(self, length: int) -> tuple[Piece, Piece | None]:
        if length >= len(self.ids):
            return self, None
        return Piece(self.doc, self.start, self.ids[:length], self.total, self.prompt), Piece(self.doc, self.start + length, self.ids[length:], self.total, self.prompt)

    def within(self, tokens: int, loss: int) -> int:
        """The longest head of at most so many tokens and loss-bearing tokens."""
        free = max(0, self.prompt - self.start)
        return min(len(self.ids), tokens, free + loss)


@dataclass
class Packer:
    limits: Limits
    closed: list[list[Piece]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.caps = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=np.float64)
        self.room = np.zeros((0, 3), dtype=np.int64)
        self.bins: list[list[Piece]] = []

    def _put(self, b: int, piece: Piece) -> None:
        self.bins[b].append(piece)
        self.room[b] -= (len(piece.ids), 1, piece.loss())
        if not self.room[b, 0] or not self.room[b, 1]:
            self._close(b)

    def _close(self, b: int) -> None:
        self.closed.append(self.bins.pop(b))
        self.room = np.delete(self.room, b, axis=0)

    def _open(self) -> int:
        self.bins.append([])
        self.room = np.vstack([self.room, self.caps.astype(np.int64)])
        return len(self.bins) - 1

    def add(self, piece: Piece | None) -> None:
        most = self.limits
        while piece is not None and len(piece.ids):
            head = piece.within(most.tokens, most.loss)
            if len(piece.ids) >= most.tokens or head < len(piece.ids):
                whole, piece = piece.cut(head)
                self._put(self._open(), whole) if head < most.tokens else self.closed.append([whole])
                continue
            need = np.array([len(piece.ids), 1, piece.loss()])
            fits = (self.room >= need).all(axis=1)
            if fits.any():
                score = np.where(fits, (self.room / self.caps) @ (need / self.caps), -1.0)
                self._put(int(score.argmax()), piece)
                return
            if len(self.bins) < most.open_bins:
                self._put(self._open(), piece)
                return
            b = int(self.room[:, 0].argmin())
            take = piece.within(int(self.room[b, 0]), int(self.room[b, 2]))
            if take <= 0:
                self._close(b)
                continue
            head_piece, piece = piece.cut(take)
            self._put(b, head_piece)

    def finish(self) -> None:
        """Cut what is still open into full sequences and, at last, into powers of two."""
        rest = [p for b in sorted(self.bins, key=len) for p in b]
        self.bins, self.room = [], np.zeros((0, 3), dtype=np.int64)
        left = sum(len(p.ids) for p in rest)
        goal, now, room = 0, [], [0, 0]
        for piece in rest:
            at: Piece | None = piece
            while at is not None:
                if not goal:
                    goal = self.limits.tokens if left >= self.limits.tokens else 1 << (left.bit_length() - 1)
                    room = [goal, self.limits.loss]
                take = at.within(*room) if len(now) < self.limits.segments else 0
                if take:
                    head, at = at.cut(take)
                    now.append(head)
                    room = [room[0] - take, room[1] - head.loss()]
                    left -= take
                if not room[0] or not take:
                    self.closed.append(now)
                    goal, now = 0, []
        if now:
            self.closed.append(now)


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("segment", pa.int32()), ("loss_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _pack(path: str, end: int, limits: Limits, ids_out: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits)
        n = TaskContext.get().partitionId() << 36

        def drain() -> Iterator[pa.RecordBatch]:
            nonlocal n
            rows = []
            for sequence in packer.closed:
                offset = 0
                for k, p in enumerate(sequence):
                    rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, n, offset, k, p.loss(), p.ids.astype(np.int32) if ids_out else None))
                    offset += len(p.ids)
                n += 1
            packer.closed = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

        for batch in batches:
            for doc, prompt, ids in zip(batch["doc_id"].to_pylist(), batch["prompt"].to_pylist(), encoder(path).encode(batch["text"], end), strict=True):
                packer.add(Piece(doc, 0, ids, len(ids), prompt))
                if len(packer.closed) > 500:
                    yield from drain()
        packer.finish()
        yield from drain()

    return f


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, limits: Limits = Limits(), prompt_tokens: Column | None = None, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, segment, loss_tokens (and ids if asked for).

    A document is its tokenizer ids and ``end``; null or empty text: ``end`` alone. ``prompt_tokens``: leading tokens
    without loss (none by default). Rows with equal or null doc_id are packed apart, each under its own id. Empty table: no rows.
    """
    prompt = F.lit(0) if prompt_tokens is None else F.coalesce(prompt_tokens.cast("int"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), prompt.alias("prompt"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens long, ids array<int>"
    out = rows.mapInArrow(_pack(tokenizer, end, limits, ids), schema)
    return out if ids else out.drop("ids")
