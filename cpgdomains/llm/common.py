"""What the corpus operators share: the shared folder, ranges of document ids, and Arrow access to bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id: before all others.
NO_ID = -(2**63)
#: Ranges of ids at most: their bounds, 8 bytes each, go to every task. Beyond about 8 TB of text the ranges grow instead.
MOST_RANGES = 1 << 20


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is unset, a temporary folder of the application stands for it on a local master; elsewhere it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="corpus-")
        base = _own[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the machine: a Python worker that waits for its next task then holds little."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(columns: list[str]) -> list[Column]:
    """Columns by their exact names, whatever characters these have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows with a number of their own, and that column's name, which ``docs`` doesn't have.

    It tells rows apart that share a doc_id or have none. In a Parquet file it is the row's place in the file, and the file's place
    among all, the same for every reader however the files are split. Other rows are written to the shared folder with numbers.
    """
    taken = {c.lower() for c in docs.columns}
    key, file = (next(n for i in range(len(taken) + 1) if (n := base + "_" * i) not in taken) for base in ("row_number", "row_file"))
    try:
        if "_metadata" in taken:
            raise AnalysisException("the files' column is hidden")
        placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(key))
    except AnalysisException:
        return materialise(docs.withColumn(key, F.monotonically_increasing_id()), name), key
    files = sorted(r[0] for r in placed.select(file).distinct().collect())  # a row per file
    if len(files) < 2:
        return placed.drop(file), key
    base = docs.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(files)], [file, "row_base"])
    small = F.broadcast(base) if len(files) < 1 << 16 else base  # some hundred bytes a file
    return placed.join(small, file).select(*named(docs.columns), (F.col(key) + F.col("row_base")).alias(key)), key


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def id_or_first(column: str = "doc_id") -> Column:
    """The id as long; rows without an id come first, as one document id of their own."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


#: Bytes that a row counts beside its text, cells of ids counted at once for each range, and cells into which a full one is split.
ROW, FINE, AGAIN = 64, 16, 256


@dataclass(frozen=True)
class Ranges:
    """Ranges of doc_id. ``group``: a row's range; ``ranks``: ranges of one id share a rank, all others have their own; both ascend with the ids."""

    group: Column
    ranks: np.ndarray
    rows: int
    bytes: int


def range_groups(docs: DataFrame, group_bytes: int, tie: Column | None = None) -> Ranges:
    """Ranges of doc_id of about ``group_bytes`` of text at most, over ``docs(doc_id, text)``; three a shuffle partition at least.

    Bytes are counted per cell of ids, and cells that are too full are counted again in smaller ones, so that only a single id
    can be over the limit; it is cut into pieces by ``tie``, a long that differs between its rows as a hash does. (A single row
    can't be cut.) Counts are partial before they are shuffled; the driver gets a row per cell: a multiple of the ranges, of which
    there are ``MOST_RANGES`` at most, never one per document. The group is a pure function of id, tie and bounds, so a
    recomputed task deals the same.
    """
    rows = docs.select(id_or_first().alias("id"), (F.octet_length(text_bytes()).cast("long") + ROW).alias("size"))
    known = F.when(F.col("id") != NO_ID, F.col("id"))
    n, total, least, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.min(known), F.max(known)).first()
    limit = max(1, min(group_bytes, -(-total // (3 * shuffle_partitions(docs.sparkSession)))), total // MOST_RANGES)
    cells: list[tuple[int, int, int]] = []  # (first id, last id, bytes)
    if total > limit:
        width = max(0, ((most or 0) - (least or 0)).bit_length() - min(MOST_RANGES, FINE * -(-total // limit)).bit_length())
        # rows without an id are a cell of their own
        cell = F.when(F.col("id") != NO_ID, F.shiftright("id", width) - ((least or 0) >> width)).otherwise(-1)
        cells = _cells(rows.withColumn("cell", cell))
        while full := [c for c in cells if c[2] > limit and c[0] < c[1]]:
            inside = _inside(np.array([c[0] for c in full]), np.array([c[1] for c in full]))
            finer = _cells(rows.withColumn("cell", inside(F.col("id"))).where("cell >= 0"))
            cells = sorted([c for c in cells if not (c[2] > limit and c[0] < c[1])] + finer)
    last: list[int] = []
    pieces: list[int] = []
    held = 0
    for first, end, size in cells:
        if last and pieces[-1] == 1 and held + size <= limit:
            last[-1] = end
            held += size
            continue
        # an id that is cut stands alone
        last.append(end)
        pieces.append(-(-size // limit) if first == end and tie is not None else 1)
        held = size
    pieces_of = np.array(pieces or [1], dtype=np.int64)
    starts = np.cumsum(pieces_of) - pieces_of
    edges = np.array(last[:-1], dtype=np.int64)
    ranks = np.repeat(np.arange(len(pieces_of)), pieces_of)
    if (pieces_of == 1).all():

        @F.pandas_udf("int")
        def group(ids: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), side="left").astype(np.int32))

        return Ranges(group(id_or_first()), ranks, n, total)

    @F.pandas_udf("int")
    def cut(ids: pd.Series, ties: pd.Series) -> pd.Series:
        at = np.searchsorted(edges, ids.to_numpy(np.int64), side="left")
        high = (ties.to_numpy(np.int64).view(np.uint64) >> np.uint64(32)).astype(np.int64)
        return pd.Series((starts[at] + (high * pieces_of[at] >> 32)).astype(np.int32))

    return Ranges(cut(id_or_first(), tie), ranks, n, total)


def _cells(rows: DataFrame) -> list[tuple[int, int, int]]:
    found = rows.groupBy("cell").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.sum("size").alias("size")).toArrow()
    return sorted(zip(*(found[c].to_pylist() for c in ("first", "last", "size")), strict=True))


def _inside(first: np.ndarray, last: np.ndarray):
    """The cell of an id, of ``AGAIN`` cells in each of some ranges in order; -1 outside."""
    widths = np.array([max(0, (b - a).bit_length() - AGAIN.bit_length() + 1) for a, b in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.uint64)

    @F.pandas_udf("long")
    def cell(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy(np.int64)
        at = np.maximum(np.searchsorted(first, x, side="right") - 1, 0)
        fine = (x.view(np.uint64) - first[at].view(np.uint64)) >> widths[at]
        return pd.Series(np.where((x >= first[at]) & (x <= last[at]), at * (2 * AGAIN) + np.minimum(fine, np.uint64(2 * AGAIN - 1)).astype(np.int64), -1))

    return cell


def raw(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls; the bytes of value i are bytes[offsets[i]:offsets[i+1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets.astype(np.int64)


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive values of at most ``most`` bytes together (a longer value stands alone)."""
    at, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield at, len(lengths)


#: Powers of a base that a worker keeps.
POWERS = (1 << 20) + 1
_powers_of: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2 ** 64."""
    known = _powers_of.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, POWERS), base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= POWERS:
            _powers_of[base] = known
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result hangs on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
