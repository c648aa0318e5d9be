"""Exact dedup by an extendible-hash index kept in shared files.

1. Texts hash to 64 bits. The distinct hashes with their texts' sizes go to regions of leading bits, about ``REGION`` hashes
   each. A region's buckets split on their next bit, and the directory doubles, until none is over the capacity; a bucket
   of one hash never splits, however long its text. Three jobs, whatever the number of buckets; no bucket comes to the driver.
2. Each task first folds the equal texts of its rows (bytes compared), so a text that a third of all rows hold sends
   about one entry per task. Entries go to the owner of their key range; owners follow the bytes, and end where buckets end.
3. An owner reads its range in hash order, the directory's entries among them. Entries of one hash form a chain; bytes are
   compared along it, so different texts of one hash stay apart. It writes one index entry per text.
4. The directory and the bucket pages lie in the shared folder as Parquet. Rows find their entry by (hash, digest).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, id_or_first, release, shared_dir, shuffle_partitions, text_bytes

#: Distinct hashes of a region, and bytes that an index entry counts beside its text.
REGION, ENTRY = 1 << 17, 64
#: Bytes of text an owner gets, and owners at most: their bounds, 12 bytes each, go to every task.
OWNER_BYTES, MOST_OWNERS = 64 << 20, 1 << 18
#: Bytes of text that a task folds at once.
FOLDED = 32 << 20
#: Turns the order of signed longs into that of the unsigned hashes.
_FLIP = -(2**63)


@dataclass(frozen=True)
class Index:
    """Paths of an index: ``directory`` (a row per bucket) and ``pages`` (one row per distinct text).

    A bucket covers the 2 ** (depth of the index - its own depth) slots from its prefix on.
    """

    path: str
    depth: int
    buckets: int
    owners: int

    def pages(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/pages")

    def directory(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/directory")


def split(keys: np.ndarray, sizes: np.ndarray, capacity: int, prefix: int = 0, depth: int = 0) -> list[tuple[int, int, int]]:
    """(prefix, depth, bytes) of the buckets below a prefix, in key order; ``keys``: its ascending distinct hashes.

    An overfull bucket splits on its next bit unless one hash is all it holds.
    """
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out, work = [], [(prefix, depth, 0, len(keys))]
    while work:
        p, d, lo, hi = work.pop()
        size = int(ends[hi] - ends[lo])
        if size <= capacity or hi - lo <= 1:
            out.append((p, d, size))
            continue
        upper = p << 1 | 1
        mid = lo + int(np.searchsorted(keys[lo:hi], np.uint64(upper << (63 - d))))
        work += [(upper, d + 1, mid, hi), (p << 1, d + 1, lo, mid)]
    return out


_DIRECTORY = {"bucket": pa.int64(), "first": pa.int64(), "depth": pa.int32(), "bytes": pa.int64(), "owner": pa.int32()}


def _buckets(bits: int, before: dict[int, int], total: int, owners: int, capacity: int):
    """A region's part of the directory; ``before``: bytes of the regions before each."""

    def f(key, rows):
        region = key[0].as_py()
        rows = rows.sort_by("k")
        keys = rows["k"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        found = split(keys, rows["bytes"].to_numpy() + ENTRY, capacity, region, bits)
        sizes = np.array([s for *_, s in found], dtype=np.int64)
        starts = before[region] + np.cumsum(sizes) - sizes
        # the unsigned first hash of a bucket, in the order of signed longs
        first = [(p << (64 - d)) + _FLIP if d else _FLIP for p, d, _ in found]
        owner = [s * owners // max(1, total) for s in starts.tolist()]
        columns = ([(region << 32) + i for i in range(len(found))], first, [d for _, d, _ in found], sizes, owner)
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(_DIRECTORY.items(), columns, strict=True)})

    return f


_ENTRY = {"owner": pa.int32(), "k": pa.int64(), "keep_id": pa.int64(), "keep_row": pa.int64(), "n": pa.int64(), "text": pa.binary()}


def _fold(firsts: np.ndarray, owners: np.ndarray, most: int = FOLDED):
    """Equal texts of a task become one entry: owner, largest (id, row) and number of rows.

    When the texts held pass ``most`` bytes, those met once leave; repeated ones stay while they fill half of it at most.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def out(gone: list[tuple[bytes, list]]) -> pa.RecordBatch:
            k = np.array([e[0] for _, e in gone], dtype=np.int64)
            owner = owners[np.searchsorted(firsts, k, side="right") - 1]
            columns = (owner, k, *([e[i] for _, e in gone] for i in (1, 2, 3)), [t for t, _ in gone])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ENTRY.values(), strict=True)], names=list(_ENTRY))

        for batch in batches:
            for doc, row, k, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "row", "k", "text")), strict=True):
                entry = held.get(text)
                if entry is None:
                    held[text] = [k, doc, row, 1]
                    size += len(text)
                    if size > most:
                        again = {t: e for t, e in held.items() if e[3] > 1}
                        size = sum(map(len, again))
                        again = again if size <= most // 2 else {}
                        size *= bool(again)
                        yield out([x for x in held.items() if x[0] not in again])
                        held = again
                else:
                    if (doc, row) > (entry[1], entry[2]):
                        entry[1:3] = doc, row
                    entry[3] += 1
        if held:
            yield out(list(held.items()))
        del held
        release()

    return f


_PAGE = {"bucket": pa.int64(), "depth": pa.int32(), "h": pa.int64(), "place": pa.int32(), "digest": pa.string(), "keep_id": pa.int64(), "keep_row": pa.int64(), "group_size": pa.int64()}


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's key range in hash order, each bucket led by its directory entry: chain the collisions of a hash, compare bytes."""
    chain: dict[bytes, list] = {}
    bucket, at = (0, 0), None

    def out(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_PAGE)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PAGE.values(), strict=True)], names=list(_PAGE))

    def flush() -> list:
        return [(*bucket, at ^ _FLIP, i, hashlib.sha256(text).hexdigest(), *e) for i, (text, e) in enumerate(sorted(chain.items()))]

    rows: list = []
    for batch in batches:
        for k, b, depth, doc, row, n, text in zip(*(batch[c].to_pylist() for c in ("k", "bucket", "depth", "keep_id", "keep_row", "n", "text")), strict=True):
            if n is None or k != at:
                rows += flush()
                chain = {}
            if n is None:
                bucket, at = (b, depth), None
                continue
            at = k
            entry = chain.get(text)  # Python compares the bytes of equal hashes
            if entry is None:
                chain[text] = [doc, row, n]
            else:
                if (doc, row) > (entry[0], entry[1]):
                    entry[:2] = doc, row
                entry[2] += n
        if len(rows) > 5000:
            yield out(rows)
            rows = []
    yield out(rows + flush())


def build_index(docs: DataFrame, normalise: Column | None = None, capacity: int = 16 << 20, row: str | None = None) -> Index:
    """Index the texts of ``docs(doc_id, text)`` in the shared folder; ``capacity``: bytes of text a bucket holds.

    A text longer than the capacity has a bucket of its own. Null texts count as empty. ``row``: column that tells rows of
    one doc_id apart. An empty table gives an index of one empty bucket. Other columns are not read.
    """
    spark = docs.sparkSession
    hashed = keyed(docs, normalise, row)
    held = shared_dir(spark, "extendible")
    hashed.groupBy("h").agg(F.max(F.octet_length("text")).cast("long").alias("bytes")).write.parquet(f"{held}/sizes")
    sizes = spark.read.schema("h long, bytes long").parquet(f"{held}/sizes").withColumn("k", F.col("h").bitwiseXOR(F.lit(_FLIP)))
    n = sizes.count()
    bits = max(0, (n // REGION).bit_length())
    region = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    by_region = sizes.withColumn("region", region)
    # a row per region: a hundred thousandth of the distinct texts
    full = dict(sorted((r[0], r[1]) for r in by_region.groupBy("region").agg(F.sum("bytes") + ENTRY * F.count(F.lit(1))).collect()))
    total, before = 0, {}
    for k, size in full.items():
        before[k] = total
        total += size
    owners = max(1, min(MOST_OWNERS, max(shuffle_partitions(spark), -(-total // OWNER_BYTES))))
    names = "bucket long, first long, depth int, bytes long, owner int"
    by_region.groupBy("region").applyInArrow(_buckets(bits, before, total, owners, capacity), names).write.parquet(f"{held}/directory")
    directory = spark.read.schema(names).parquet(f"{held}/directory")
    bounds = directory.groupBy("owner").agg(F.min("first").alias("first"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n")).toArrow().sort_by("first")
    firsts, ids = bounds["first"].to_numpy(), bounds["owner"].to_numpy()
    if not n:
        firsts, ids = np.array([_FLIP]), np.array([0], dtype=np.int32)
    firsts = firsts.copy()
    firsts[0] = _FLIP  # nothing lies before the first bucket
    entries = hashed.withColumn("k", F.col("h").bitwiseXOR(F.lit(_FLIP))).select("doc_id", "row", "k", "text")
    entries = entries.mapInArrow(_fold(firsts, ids), "owner int, k long, keep_id long, keep_row long, n long, text binary")
    marks = directory.select("owner", F.col("first").alias("k"), "bucket", "depth")
    dealt = entries.unionByName(marks, allowMissingColumns=True).repartitionById(owners, F.col("owner"))
    ordered = dealt.sortWithinPartitions("k", F.col("n").isNotNull())
    pages = ordered.mapInArrow(_chains, "bucket long, depth int, h long, place int, digest string, keep_id long, keep_row long, group_size long")
    pages.write.parquet(f"{held}/pages")
    return Index(held, max(bounds["depth"].to_pylist(), default=0), sum(bounds["n"].to_pylist()), owners)


def keyed(docs: DataFrame, normalise: Column | None = None, row: str | None = None) -> DataFrame:
    """(doc_id, row, text bytes, 64-bit hash) of the texts, normalised by an expression of column text if one is given."""
    text = text_bytes() if normalise is None else F.coalesce(normalise, F.lit("")).cast("binary")
    own = F.lit(0) if row is None else F.col(row)
    return docs.select(id_or_first().alias("doc_id"), own.cast("long").alias("row"), text.alias("text")).withColumn("h", F.xxhash64("text"))


def lookup(docs: DataFrame, index: Index, normalise: Column | None = None, row: str | None = None) -> DataFrame:
    """Each row's index entry: doc_id, row, keep_id, keep_row, group_size, text_sha256.

    Rows whose text the index lacks get nulls. The join's sides are ids and digests only, and AQE may split a hot key.
    """
    rows = keyed(docs, normalise, row).select("doc_id", "row", "h", F.sha2("text", 256).alias("text_sha256"))
    pages = index.pages(docs.sparkSession).select("h", F.col("digest").alias("text_sha256"), "keep_id", "keep_row", "group_size")
    return rows.join(pages, ["h", "text_sha256"], "left").drop("h")


def exact_dedup(docs: DataFrame, normalise: Column | None = None, capacity: int = 16 << 20, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and the column ``row`` if one is named.

    Of equal texts the row with the largest doc_id stays, and of equal doc_ids the one with the largest ``row``; without that
    column, rows that repeat the same doc_id and text are all marked kept. Null text: empty. A null doc_id counts as the
    smallest id and is returned as null. Texts of any length: one over the capacity fills a bucket alone. Empty table: no
    rows. Other columns are not read, so their names can't clash.
    """
    found = lookup(docs, build_index(docs, normalise, capacity, row), normalise, row)
    null = lambda c: F.when(F.col(c) != F.lit(NO_ID), F.col(c))
    kept = (F.col("doc_id") == F.col("keep_id")) & (F.col("row") == F.col("keep_row"))
    own = [F.col("row").alias(row)] if row else []
    return found.select(null("doc_id").alias("doc_id"), *own, null("keep_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
