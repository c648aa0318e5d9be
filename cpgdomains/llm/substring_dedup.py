"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Documents are dealt to ranges of doc_id (one shuffle of the texts, used three times); a range numbers its windows' hashes.

1. Each range sends some leading bits of every distinct hash once, sorted and delta-packed, to the bucket of their own leading
   bits: a window that a third of all documents hold is one entry per range. There are about ``SPARE`` more of these bits than it takes to
   number all windows, so few windows share them by chance. A bucket tells each range which of them other ranges have too.
2. Of those windows each range sends the whole hash of ``BITS`` bits with another of 64 bits over the window's words themselves to
   the buckets, which tell all ranges but the first what an earlier one has. So a chance agreement of 112 bits is needed to remove
   a word: one of 10 million corpora of 100 TB would see one.
3. A range removes windows that a smaller range has, and those that a smaller document of its own has, told apart by the same
   112 bits; covered words merge into maximal intervals. As ranges follow doc_id, no ids travel.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import NO_ID, id_or_first, mixed, named, powers, range_groups, raw, release, shuffle_partitions, slices, text_bytes

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20_240_101).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes hashed at once; a longer document is hashed in parts that end at white space.
_CHUNK = 1 << 20
_WHITE = re.compile(rb"[\x20\t-\r]")
#: Bits of a window's hash; and how many more than it takes to number all windows ranges first look for common ones by.
BITS, SPARE = 48, 6


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; much faster on large arrays than a hash table."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each document) of documents lying end to end in ``data``."""
    n_docs = len(offsets) - 1
    lo, hi = int(offsets[0]), int(offsets[-1])
    if lo == hi:
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    data, offsets = data[lo:hi], offsets - lo
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
    back = powers(pow(_BASE, -1, 2**64), len(data))
    hashes = mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _U(_WINDOW_BASE))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def window_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of every window of ``size`` words that lies in one document."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(_WINDOW_BASE, len(words)), out=sums[1:])
    hashes = mixed((sums[size:] - sums[:-size]) * powers(pow(_WINDOW_BASE, -1, 2**64), n))
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words to the document's end
    at = np.flatnonzero(left[:n] >= size)
    return hashes[at], at


def pack(values: np.ndarray) -> bytes:
    """Sorted hashes as differences of the fewest whole bytes: first value, width, the rest."""
    if not len(values):
        return b""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return values[:1].astype("<u8").tobytes() + bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width, rest = blob[8], np.frombuffer(blob, np.uint8, offset=9)
    out = np.zeros((len(rest) // width + 1, 8), dtype=np.uint8)
    out[1:, :width] = rest.reshape(-1, width)
    out = out.view("<u8").ravel()
    out[0] = np.frombuffer(blob, "<u8", 1)[0]
    return np.cumsum(out, dtype=np.uint64)


def _parts(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Where a long document's parts end, each at white space."""
    text, cuts = memoryview(data)[:stop], [start]
    while stop - cuts[-1] > _CHUNK and (m := _WHITE.search(text, cuts[-1] + _CHUNK)):
        cuts.append(m.end())
    return np.array([*cuts, stop] if cuts[-1] < stop else cuts)


@dataclass
class Windows:
    """The windows of a range's documents, in order: hash, document, first word; and each document's number of words."""

    hash: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    counts: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    size: int

    @classmethod
    def of(cls, texts: pa.ChunkedArray, size: int, bits: int) -> Windows:
        data, offsets = raw(texts)
        found, n_words = [], []
        for i, j in slices(np.diff(offsets), _CHUNK):
            if offsets[j] - offsets[i] > _CHUNK:  # one long document
                cuts = _parts(data, int(offsets[i]), int(offsets[j]))
                words = np.concatenate([word_hashes(data, cuts[k : k + 2])[0] for k in range(len(cuts) - 1)])
                counts = np.array([len(words)])
            else:
                words, counts = word_hashes(data, offsets[i : j + 1])
            h, at = window_hashes(words, counts, size)
            ends = np.cumsum(counts)
            doc = np.searchsorted(ends, at, side="right")
            found.append((h >> _U(64 - bits) if bits else h & _U(0), (doc + i).astype(np.int32), (at - (ends - counts)[doc]).astype(np.int32)))
            n_words.append(counts)
        join = lambda k, t: np.concatenate([x[k] for x in found]) if found else np.zeros(0, t)
        return cls(join(0, np.uint64), join(1, np.int32), join(2, np.int32), np.concatenate(n_words) if n_words else np.zeros(0, np.int64), data, offsets, size)

    def text(self, doc: int) -> bytes:
        return self.data[self.offsets[doc] : self.offsets[doc + 1]].tobytes()

    def second(self, which: np.ndarray) -> np.ndarray:
        """Another 64 bits of some windows, ascending, from their words themselves."""
        out = np.zeros(len(which), dtype=np.uint64)
        docs, first = np.unique(self.doc[which], return_index=True)
        stops = [*first[1:].tolist(), len(which)]
        digest = xxhash.xxh3_64_intdigest
        for d, s, e in zip(docs.tolist(), first.tolist(), stops, strict=True):
            words = self.text(d).split()
            joined = memoryview(b" ".join(words))
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            at = self.place[which[s:e]]
            begins = np.where(at > 0, ends[at - 1], 0).tolist()
            out[s:e] = np.fromiter((digest(joined[x:y]) for x, y in zip(begins, (ends[at + self.size - 1] - 1).tolist(), strict=True)), np.uint64, e - s)
        return out


def _edges(buckets: int, bits: int) -> np.ndarray:
    return (np.arange(1, buckets, dtype=object) * 2**bits // buckets).astype(np.uint64)


def _send(size: int, bits: int, few: int, buckets: int):
    """Every distinct window's first ``few`` bits, by bucket."""

    def f(key, rows):
        group = key[0].as_py()
        some = distinct(Windows.of(rows["text"], size, bits).hash >> _U(bits - few))
        parts = np.split(some, np.searchsorted(some, _edges(buckets, few)))
        full = [b for b, p in enumerate(parts) if len(p)]
        out = pa.table({"bucket": pa.array(full, pa.int32()), "g": pa.array([group] * len(full), pa.int32()), "hashes": pa.array([pack(parts[b]) for b in full], pa.binary())})
        del some, parts
        release()
        return out

    return f


def _shared(ranks: np.ndarray):
    def f(rows):
        """Of one bucket: to each range the leading bits that ranges of other ids have too."""
        rows = rows.sort_by("g")
        groups = rows["g"].to_pylist()
        lists = [unpack(b) for b in rows["hashes"].to_pylist()]
        ends = np.cumsum([len(x) for x in lists])
        hashes = np.concatenate(lists)
        rank = np.repeat(ranks[groups], [len(x) for x in lists])
        del lists
        order = np.argsort(hashes, kind="stable")  # by rank within equal hashes
        h, r = hashes[order], rank[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        last = np.concatenate([first[1:], [len(h)]]) - 1
        both = np.zeros(len(h), dtype=bool)
        both[order] = np.repeat(r[first] != r[last], last - first + 1)
        out = [(g, pack(hashes[s:e][both[s:e]])) for g, s, e in zip(groups, [0, *ends[:-1]], ends, strict=True) if both[s:e].any()]
        del hashes, order, both, h, r
        release()
        return pa.table({"g": pa.array([g for g, _ in out], pa.int32()), "shared": pa.array([b for _, b in out], pa.binary())})

    return f


def _confirm(size: int, bits: int, few: int, buckets: int):
    """The windows that other ranges may have: both hashes of each distinct one, by bucket of the first."""

    def f(key, rows, found):
        lists = [unpack(b) for b in found["shared"].to_pylist()]
        full: list[int] = []
        h = x = np.zeros(0, np.uint64)
        parts = [(h, x)]
        if lists and len(rows):
            shared = np.sort(np.concatenate(lists))
            w = Windows.of(rows["text"], size, bits)
            which = np.flatnonzero(held(shared, w.hash >> _U(bits - few)))
            h, x = w.hash[which], w.second(which)
            order = np.lexsort((x, h))
            h, x = h[order], x[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (x[1:] != x[:-1])]) if len(h) else np.zeros(0, bool)
            h, x = h[new], x[new]
            cuts = np.searchsorted(h, _edges(buckets, bits))
            parts = list(zip(np.split(h, cuts), np.split(x, cuts), strict=True))
            full = [b for b, (p, _) in enumerate(parts) if len(p)]
        group = key[0].as_py()
        out = pa.table({
            "bucket": pa.array(full, pa.int32()), "g": pa.array([group] * len(full), pa.int32()),
            "hashes": pa.array([pack(parts[b][0]) for b in full], pa.binary()), "second": pa.array([parts[b][1].astype("<u8").tobytes() for b in full], pa.binary()),
        })
        del lists, parts, h, x
        release()
        return out

    return f


def held(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values are among the ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _repeated(ranks: np.ndarray):
    def f(rows):
        """Of one bucket: to each range the windows that a range of smaller ids has too."""
        rows = rows.sort_by("g")
        groups = rows["g"].to_pylist()
        lists = [unpack(b) for b in rows["hashes"].to_pylist()]
        ends = np.cumsum([len(x) for x in lists])
        h, x = np.concatenate(lists), np.concatenate([np.frombuffer(b, "<u8") for b in rows["second"].to_pylist()])
        rank = np.repeat(ranks[groups], [len(y) for y in lists])
        del lists
        order = np.lexsort((x, h))  # stable: by rank within equal windows
        new = np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (x[order[1:]] != x[order[:-1]])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        again = np.zeros(len(h), dtype=bool)
        again[order] = rank[order] > rank[order[first]]
        out = [(g, h[s:e][again[s:e]], x[s:e][again[s:e]]) for g, s, e in zip(groups, [0, *ends[:-1]], ends, strict=True) if again[s:e].any()]
        table = pa.table({"g": pa.array([g for g, *_ in out], pa.int32()), "hashes": pa.array([pack(y) for _, y, _ in out], pa.binary()), "second": pa.array([y.astype("<u8").tobytes() for *_, y in out], pa.binary())})
        del h, x, order, again, out
        release()
        return table

    return f


def covered(at: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Words that some window starting at one of ``at`` covers."""
    steps = np.zeros(n_words + 1, dtype=np.int32)
    steps[at] += 1
    np.subtract.at(steps, at + size, 1)
    return np.cumsum(steps[:-1]) > 0


def _again(w: Windows, ids: np.ndarray, h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Windows that an earlier range has, as (h, x) in order, or a smaller document of this one."""
    if not len(w.hash):
        return np.zeros(0, dtype=bool)
    order = np.argsort(w.hash, kind="stable")
    sorted_h, owner = w.hash[order], ids[w.doc[order]]
    first = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))
    last = np.concatenate([first[1:], [len(order)]]) - 1
    suspect = held(h, w.hash)
    suspect[order[np.repeat(owner[first] != owner[last], last - first + 1)]] = True
    which = np.flatnonzero(suspect)
    out = np.zeros(len(w.hash), dtype=bool)
    if not len(which):
        return out
    own_h, own_x, owner = w.hash[which], w.second(which), ids[w.doc[which]]
    known = np.zeros(len(which), dtype=bool)
    at, unsure = np.searchsorted(h, own_h), np.arange(len(which))
    while len(unsure):  # one round, but for chance agreements of the first hash
        inside = at[unsure] < len(h)
        unsure = unsure[inside]
        unsure = unsure[h[at[unsure]] == own_h[unsure]]
        same = x[at[unsure]] == own_x[unsure]
        known[unsure[same]] = True
        unsure = unsure[~same]
        at[unsure] += 1
    order = np.lexsort((own_x, own_h))  # ids ascend, so the first of equal windows has the smallest
    new = np.concatenate([[True], (own_h[order[1:]] != own_h[order[:-1]]) | (own_x[order[1:]] != own_x[order[:-1]])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    known[order] |= owner[order] > owner[order[first]]
    out[which] = known
    return out


def _remove(size: int, bits: int, texts_out: bool, carry: bool):
    def f(key, rows, found):
        rows = rows.take(pc.sort_indices(rows["id"]))
        ids = rows["id"].to_numpy()
        lists = [(unpack(a), np.frombuffer(b, "<u8")) for a, b in zip(found["hashes"].to_pylist(), found["second"].to_pylist(), strict=True)]
        h, x = (np.concatenate([y[k] for y in lists]) if lists else np.zeros(0, np.uint64) for k in (0, 1))
        order = np.lexsort((x, h))
        h, x = h[order], x[order]
        del lists, order
        w = Windows.of(rows["text"], size, bits)
        again = _again(w, ids, h, x)
        docs, first = np.unique(w.doc[again], return_index=True)
        places = dict(zip(docs.tolist(), np.split(w.place[again], first[1:]), strict=True)) if len(docs) else {}
        out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans")}
        for d, n in enumerate(w.counts.tolist()):
            text = w.text(d)
            words = text.split()
            removed, edges = 0, []
            if d in places:
                mask = covered(places[d], n, size)
                removed = int(mask.sum())
                words = itertools.compress(words, (~mask).tolist())
                edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist()
            kept = b" ".join(words)
            out["doc_id"].append(int(ids[d]))
            out["n_words"].append(n)
            out["n_removed"].append(removed)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append((kept if removed else text) if texts_out else None)
            out["spans"].append(edges)
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.int64())}
        table = pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()} | {"missing": rows["missing"]} | ({"carried": rows["carried"]} if carry else {}))
        del h, x, w, again, out
        release()
        return table

    return f


def substring_dedup(docs: DataFrame, size: int = 13, group_bytes: int = 12 << 20, bucket_bytes: int = 24 << 20, texts: bool = False, carry: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept_sha256, spans, the columns ``carry`` as they were in a struct
    ``carried``, and kept_text if ``texts``: the kept words joined by one space, or the text as it was (null too) if none goes.

    A word goes if a window of ``size`` words that covers it also starts in a document with a smaller doc_id.
    ``spans``: flat list start, end, start, end... of the maximal removed intervals, in words. Null or empty
    text: no words. A very long text is a range of its own and is hashed in parts. Rows without doc_id count as one document before
    all others and are returned with null. Rows with equal ids don't remove from each other, and many of them are dealt to several
    tasks. Empty table: no rows. ``bits``: leading bits of the first hash that are used; fewer change nothing but the time.
    """
    tie = F.xxhash64("text", F.spark_partition_id())  # equal rows too are dealt apart
    ranges = range_groups(docs, group_bytes, tie)
    few = min(bits, (ranges.bytes // 6).bit_length() + SPARE)
    buckets = max(shuffle_partitions(docs.sparkSession), -(-(ranges.bytes // 6 * 8) // bucket_bytes))
    carried = [F.struct(*named(list(carry))).alias("carried")] if carry else []
    dealt = docs.select(id_or_first().alias("id"), text_bytes().alias("text"), F.col("text").isNull().alias("missing"), ranges.group.alias("g"), *carried)
    sent = dealt.groupBy("g").applyInArrow(_send(size, bits, few, buckets), "bucket int, g int, hashes binary")
    shared = sent.groupBy("bucket").applyInArrow(_shared(ranges.ranks), "g int, shared binary")
    sure = dealt.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_confirm(size, bits, few, buckets), "bucket int, g int, hashes binary, second binary")
    found = sure.groupBy("bucket").applyInArrow(_repeated(ranges.ranks), "g int, hashes binary, second binary")
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary, spans array<long>, missing boolean")
    schema = StructType([*schema.fields, *(dealt.schema["carried"] for _ in carried)])
    out = dealt.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(_remove(size, bits, texts, bool(carry)), schema)
    more = [F.when(~(F.col("missing") & (F.col("n_removed") == 0)), F.decode("kept", "UTF-8")).alias("kept_text")] if texts else []
    return out.select(F.when(F.col("doc_id") != F.lit(NO_ID), F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "spans", *(["carried"] if carry else []), *more)
