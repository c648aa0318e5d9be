"""Token files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents as one stream cut into blocks. A block stores its minimum, the
differences packed at the width that a percentile of them needs, and those that need more in an exception list
(place, high bits). The index gives where each block starts, so any run of ids can be read alone.

Layout, little-endian: magic ``PFB1``; u32 documents, u64 ids, u32 block length, u32 blocks; i64 doc_id and u32
length of each document; u64 start of each block and of the end, counted from the first block; the blocks: u32 minimum,
u8 width, u16 exceptions, packed differences (low bits first, one after another), u16 places, u32 high bits.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, id_or_first, range_groups, shared_dir
from .tokens import encoder

MAGIC, HEAD = b"PFB1", struct.Struct("<4sIQII")
BLOCK, PERCENTILE = 1024, 95


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """(blocks, start of each block and of the end) of a stream of unsigned 32-bit ids."""
    out: list[bytes] = []
    n_full = len(ids) // block
    for rows in filter(len, (ids[: n_full * block].reshape(n_full, block), ids[n_full * block :].reshape(1, -1) if len(ids) % block else ids[:0])):
        low = rows.min(axis=1)
        steps = rows - low[:, None]
        widest = int(steps.max()).bit_length()
        lengths = np.zeros(steps.shape, dtype=np.uint8)  # bits that each difference needs
        for w in range(widest):
            lengths += steps >= np.uint32(1 << w)
        rank = min(rows.shape[1] - 1, int(np.ceil(rows.shape[1] * percentile / 100)) - 1)
        widths = np.partition(lengths, rank, axis=1)[:, rank]
        packed: list = [b""] * len(rows)
        octets = steps.astype("<u4").view(np.uint8).reshape(*steps.shape, 4)[:, :, : (widest + 7) // 8]
        for w in np.unique(widths[widths > 0]).tolist():
            at = np.flatnonzero(widths == w)
            for some in np.array_split(at, -(-len(at) // 128)):
                bits = np.unpackbits(octets[some], axis=2, bitorder="little", count=w)
                for k, p in zip(some.tolist(), np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little"), strict=True):
                    packed[k] = p.tobytes()
        odd = lengths > widths[:, None]
        r, c = np.nonzero(odd)
        high = (steps[r, c] >> widths[r].astype(np.uint32)).astype("<u4")
        ends = np.searchsorted(r, np.arange(len(rows) + 1))
        places = c.astype("<u2")
        for k, (m, w) in enumerate(zip(low.tolist(), widths.tolist(), strict=True)):
            s, e = ends[k], ends[k + 1]
            out.append(struct.pack("<IBH", m, w, e - s) + packed[k] + places[s:e].tobytes() + high[s:e].tobytes())
    return b"".join(out), np.cumsum([0, *map(len, out)]).astype("<u8")


def decode_blocks(data: memoryview, starts: np.ndarray, n_ids: int, block: int = BLOCK, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last - 1."""
    out = []
    for k in range(first, len(starts) - 1 if last is None else last):
        at = int(starts[k])
        low, width, odd = struct.unpack_from("<IBH", data, at)
        n = min(block, n_ids - k * block)
        size = -(-n * width // 8)
        octets = np.zeros((n, 4), dtype=np.uint8)
        if width:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at + 7), count=n * width, bitorder="little")
            octets[:, : (width + 7) // 8] = np.packbits(bits.reshape(n, width), axis=1, bitorder="little")
        steps = octets.view("<u4").ravel()
        if odd:
            at += 7 + size
            places = np.frombuffer(data, "<u2", odd, at)
            steps[places] |= np.frombuffer(data, "<u4", odd, at + 2 * odd) << np.uint32(width)
        out.append(steps + np.uint32(low))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_file(doc_ids: np.ndarray, streams: list[np.ndarray]) -> bytes:
    ids = np.concatenate(streams) if streams else np.zeros(0, np.uint32)
    blocks, starts = encode_blocks(ids)
    head = HEAD.pack(MAGIC, len(streams), len(ids), BLOCK, len(starts) - 1)
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), np.array([len(s) for s in streams], "<u4").tobytes(), starts.tobytes(), blocks])


class TokenFile:
    """Read access to a file's bytes: documents, or any run of ids, by the block index."""

    def __init__(self, data: bytes) -> None:
        magic, n_docs, self.n_ids, self.block, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.lengths = np.frombuffer(data, "<u4", n_docs, at := at + 8 * n_docs).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", n_blocks + 1, at := at + 4 * n_docs)
        self.data = memoryview(data)[at + 8 * (n_blocks + 1) :]
        self.ends = np.cumsum(self.lengths)

    def ids(self, start: int, stop: int) -> np.ndarray:
        first = start // self.block
        return decode_blocks(self.data, self.starts, self.n_ids, self.block, first, -(-stop // self.block))[start - first * self.block : stop - first * self.block]


def _write(path: str, target: str, end: int):
    def f(key, rows):
        group = key[0].as_py()
        rows = rows.take(pc.sort_indices(rows, [("id", "ascending"), ("text", "ascending")]))
        streams = list(encoder(path).encode(rows["text"], end))
        store, folder = fs.FileSystem.from_uri(target)
        name = f"{folder}/{group:09d}.pfb"
        content = write_file(rows["id"].to_numpy(), streams)
        # a repeated task writes the same bytes and moves them into place whole
        draft = f"{folder}/_{group:09d}.{zlib.crc32(content)}.{np.random.default_rng().integers(2**62)}"
        with store.open_output_stream(draft) as out:
            out.write(content)
        store.move(draft, name)
        return pa.table({"g": pa.array([group], pa.int32()), "docs": pa.array([len(streams)], pa.int64()), "ids": pa.array([sum(map(len, streams))], pa.int64()), "bytes": pa.array([len(content)], pa.int64())})

    return f


def write_token_files(docs: DataFrame, tokenizer: str, end: int = 2, group_bytes: int = 8 << 20) -> str:
    """Encode ``docs(doc_id, text)`` and write files in ascending doc_id order into the shared folder; returns its URI.

    One file per doc_id range of about ``group_bytes`` of text, named by the range's number; ``manifest`` lists them.
    Null or empty text: the end id alone. Equal doc_ids go by text within a file; many of them are several files. A null
    doc_id comes first. A very long text is a file of its own. Empty table: no file. Other columns are not read.
    """
    spark = docs.sparkSession
    target = shared_dir(spark, "tokens")
    ranges = range_groups(docs, group_bytes, F.xxhash64("text", F.spark_partition_id()))  # equal rows too can be dealt apart
    store, folder = fs.FileSystem.from_uri(f"{target}/files")
    store.create_dir(folder, recursive=True)
    dealt = docs.select(id_or_first().alias("id"), F.coalesce("text", F.lit("")).alias("text"), ranges.group.alias("g"))
    dealt.groupBy("g").applyInArrow(_write(tokenizer, f"{target}/files", end), "g int, docs long, ids long, bytes long").write.parquet(f"{target}/manifest")
    return target


def _read(batches: Iterator[pa.RecordBatch], ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, content in zip(batch["base"].to_pylist(), batch["content"], strict=True):
            file = TokenFile(content.as_py())
            crc, i = [], 0
            values = []
            while i < len(file.lengths):  # runs of documents of about a million ids
                j = max(i + 1, int(np.searchsorted(file.ends, (file.ends[i - 1] if i else 0) + (1 << 20))))
                start = int(file.ends[i - 1]) if i else 0
                run = file.ids(start, int(file.ends[j - 1]))
                for s, e in zip(file.ends[i:j] - file.lengths[i:j] - start, file.ends[i:j] - start, strict=True):
                    crc.append(zlib.crc32(run[s:e].astype("<u4").tobytes()))
                    if ids:
                        values.append(run[s:e])
                i = j
            cols = {"doc_id": pa.array(file.doc_ids, pa.int64()), "start": pa.array(base + file.ends - file.lengths, pa.int64()), "n_tokens": pa.array(file.lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if ids:
                cols["ids"] = pa.array(values, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(cols)


def read_token_files(spark: SparkSession, target: str, ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32, and the ids if asked for.

    The files' sizes come from the manifest: one row per file.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    sizes = sorted((r["g"], r["ids"]) for r in spark.read.schema("g int, docs long, ids long, bytes long").parquet(f"{target}/manifest").select("g", "ids").collect())
    if not sizes:
        return spark.createDataFrame([], schema)
    bases = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    table = spark.createDataFrame([(g, b) for (g, _), b in zip(sizes, bases, strict=False)], "g int, base long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfb").load(f"{target}/files")
    files = files.select(F.regexp_extract("path", r"(\d+)\.pfb$", 1).cast("int").alias("g"), "content")
    small = F.broadcast(table) if len(sizes) < 1 << 18 else table
    found = files.join(small, "g").select("base", "content").mapInArrow(partial(_read, ids=ids), schema)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(NO_ID), F.col("doc_id")))
