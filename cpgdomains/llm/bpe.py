"""Byte-level BPE encoding and decoding of whole texts, long ones by overlapping chunks.

A text longer than a chunk is split into chunks that overlap. All chunks are pre-tokenised in parallel. A chunk's
boundaries are right from the first one that the chunk before it has too, as a match never looks back; so the stitch
takes each chunk's boundaries up to the first common one in the overlap. Where an overlap has none (one pre-token
longer than the overlap), the text is pre-tokenised on from the last right boundary until the two agree. The pieces
between boundaries are then merged by rank, once per distinct piece. Decoding joins the tokens' bytes.

All this needs a pattern whose boundaries in a cut text, but for the last one, are those of the whole text (``CUTTABLE``). With
any other pattern each text is encoded in one piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, GENERATION = 1 << 15, 1 << 9, 150_000
#: Patterns known to be safe: a match of theirs looks at most one character ahead, to tell whether white space ends.
CUTTABLE = (public_tokenizers.PATTERN,)
_loaded: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """A rank file's merges with a bounded cache of pieces."""

    def __init__(self, ranks: str, pattern: str) -> None:
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, lines))}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(self.encoding._encode_single_piece(piece), dtype="<u4").tobytes()
        self.young[piece] = ids
        return ids

    def encode(self, pieces: list[str]) -> bytes:
        """Unsigned 32-bit ids of pre-tokens, end to end."""
        if len(self.young) > GENERATION:
            self.young, self.old = {}, self.young
        get = self.young.get
        return b"".join([get(p) or self.piece(p) for p in pieces])

    def bounds(self, text: str) -> np.ndarray:
        """Where each pre-token ends."""
        return np.cumsum(np.fromiter(map(len, self.pattern.findall(text)), dtype=np.int64))

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def codec(ranks: str, pattern: str) -> Codec:
    if (ranks, pattern) not in _loaded:
        _loaded[ranks, pattern] = Codec(ranks, pattern)
    return _loaded[ranks, pattern]


def stitch(texts: list[str], bounds: list[np.ndarray], step: int, find) -> tuple[str, np.ndarray]:
    """(whole text, pre-token ends) of chunks that start ``step`` apart; ``find`` gives the pre-token ends of a text."""
    whole = texts[0] + "".join(t[len(texts[i]) - step :] for i, t in enumerate(texts[1:]))
    right = bounds[0]
    for k in range(1, len(texts)):
        start, end = k * step, (k - 1) * step + len(texts[k - 1])
        fresh = bounds[k] + start
        right = right[right < end]  # the piece at the end of a chunk may go on
        common = np.intersect1d(right[right >= start], fresh, assume_unique=True)
        if len(common):
            right = np.concatenate([right[right <= common[0]], fresh[fresh > common[0]]])
            continue
        # no common boundary in the overlap: go on from the last right one, further each time, until one is found
        last = int(right[-1]) if len(right) else 0
        stop, reach = start + len(texts[k]), step
        while True:
            upto = min(stop, end + reach)
            more = find(whole[last:upto]) + last
            if upto == stop:
                right = np.concatenate([right, more])
                break
            more = more[more < upto]
            common = np.intersect1d(more, fresh, assume_unique=True)
            if len(common):
                right = np.concatenate([right, more[more <= common[0]], fresh[fresh > common[0]]])
                break
            reach *= 2
    return whole, right


def _cut(text: str, ends: np.ndarray) -> list[str]:
    e = ends.tolist()
    return [text[i:j] for i, j in zip([0, *e[:-1]], e, strict=True)]


def _encode_short(ranks: str, pattern: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                ids = [c.encode(c.pattern.findall(t)) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return f


def _bounds(ranks: str, pattern: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            ends = [c.bounds(t).astype("<i4").tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in ("row", "doc_id", "k", "text")), pa.array(ends, pa.binary())], names=["row", "doc_id", "k", "text", "ends"])

    return f


def _stitch(ranks: str, pattern: str, chunk: int):
    def f(rows):
        c = codec(ranks, pattern)
        rows = rows.sort_by("k")
        text, ends = stitch(rows["text"].to_pylist(), [np.frombuffer(b, "<i4").astype(np.int64) for b in rows["ends"].to_pylist()], chunk, c.bounds)
        return pa.table({"doc_id": rows["doc_id"].slice(0, 1), "ids": pa.array([c.encode(_cut(text, ends))], pa.binary())})

    return f


def encode_documents(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of ``docs(doc_id, text)``; ids: unsigned 32-bit little-endian, end to end.

    Null or empty text: no ids. Rows with equal or null doc_id are encoded apart. Special tokens' strings are
    ordinary text. Empty table: no rows. Only texts longer than a chunk are shuffled, and none whose pattern isn't in ``CUTTABLE``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    schema = "doc_id long, ids binary"
    if pattern not in CUTTABLE:
        return rows.mapInArrow(_encode_short(ranks, pattern), schema)
    short = rows.where(size <= chunk + overlap).mapInArrow(_encode_short(ranks, pattern), schema)
    long = rows.where(size > chunk + overlap).withColumn("row", F.monotonically_increasing_id())
    last = F.ceil((size - overlap) / chunk) - 1  # the last chunk reaches the text's end
    cut = long.select("row", "doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    cut = cut.select("row", "doc_id", "k", F.expr(f"substring(text, cast(k * {chunk} + 1 as int), {chunk + overlap})").alias("text"))
    marked = cut.repartition("row", "k").mapInArrow(_bounds(ranks, pattern), "row long, doc_id long, k long, text string, ends binary")
    return short.unionByName(marked.groupBy("row").applyInArrow(_stitch(ranks, pattern, chunk), schema))


def _decode(ranks: str, pattern: str, texts: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                n, digests, shas, out = [], [], [], []
                for blob in part["ids"].to_pylist():
                    ids = np.frombuffer(blob, "<u4").tolist()
                    text = c.decode(ids)
                    decimal = c.decimal
                    n.append(len(ids))
                    digests.append(hashlib.sha256(",".join([decimal[x] for x in ids]).encode()).hexdigest())
                    shas.append(hashlib.sha256(text).hexdigest())
                    out.append(text if texts else None)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(digests), pa.array(shas), pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"])

    return f


def decode_documents(encoded: DataFrame, ranks: str, pattern: str, texts: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 and, if ``texts``, the decoded bytes of (doc_id, ids)."""
    out = encoded.select("doc_id", "ids").mapInArrow(_decode(ranks, pattern, texts), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded binary")
    return out if texts else out.drop("decoded")
