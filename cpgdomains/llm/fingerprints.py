"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: lines, further cut at sentence ends, and long ones at words chosen by their hash, so that
an edit moves no other cut. The i-th occurrence of a paragraph is a digest of its own. A sketch's cells hold a count, and the
sums (exclusive or) of digests and of their checks. Two versions' sketches subtract cell by cell; peeling cells that hold
one digest recovers what differs. A fingerprint holds a small sketch and a larger one, so that any two stored fingerprints can be
compared (``compare``), which says so if they differ too much; where the texts are at hand, such a pair is sketched again larger.
Many sketches lie end to end in one set of arrays, so that a range's documents are built, subtracted and peeled together.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, id_or_first, range_groups, release, shuffle_partitions

#: Cells of a fingerprint's sketches by thirds (each digest has one cell in each third), and characters that a paragraph may have.
LEVELS, LONG = (4, 16), 160
#: Documents, and characters of their texts, compared together.
BLOCK, CHARS = 256, 4 << 20
_BREAK = re.compile(r"\n+|(?<=[.!?])\s+")
_WORDS = re.compile(r"\S+\s*")
_U = np.uint64
_CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("chk", "<u4")])


def paragraphs(text: str) -> list[str]:
    out = []
    for part in _BREAK.split(text):
        if len(part) <= LONG:
            if part:
                out.append(part)
            continue
        held = []
        for word in _WORDS.findall(part):
            held.append(word)
            if xxhash.xxh3_64_intdigest(word) & 7 == 0:
                out.append("".join(held))
                held = []
        if held:
            out.append("".join(held))
    return out


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests, one per paragraph; repeats are numbered."""
    seen: dict[str, int] = {}
    hashes, numbers = [], []
    for p in paragraphs(text):
        seen[p] = n = seen.get(p, -1) + 1
        hashes.append(xxhash.xxh3_64_intdigest(p))
        numbers.append(n)
    x = np.array(hashes, dtype=np.uint64) + np.array(numbers, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return np.unique(x ^ (x >> _U(31)))  # distinct, as a digest held twice could never be peeled


def check(d: np.ndarray) -> np.ndarray:
    return (d * _U(0x9E3779B97F4A7C15)) >> _U(32)


@dataclass
class Sketches:
    """Sketches end to end: row r has cells start[r] to start[r] + 3 * third[r]."""

    third: np.ndarray
    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    chk: np.ndarray

    @classmethod
    def of(cls, items: np.ndarray, row: np.ndarray, third: np.ndarray) -> Sketches:
        """``row``: each digest's sketch; ``third``: a third of each sketch's cells."""
        start = np.concatenate([[0], np.cumsum(3 * third)])
        n = int(start[-1])
        out = cls(third, start[:-1], np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64))
        out.toggle(items, row, 1)
        return out

    def places(self, items: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(3, n) cells. They depend on the sketch's size, so that a larger one is another try."""
        t = self.third[row].astype(np.uint64)
        x = (items ^ (t * _U(0xD1342543DE82EF95))) * _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(31)
        base = self.start[row].astype(np.uint64)
        low = _U(0x1FFFFF)
        return np.stack([base + (x & low) % t, base + t + (x >> _U(21) & low) % t, base + _U(2) * t + (x >> _U(42)) % t]).astype(np.int64)

    def toggle(self, items: np.ndarray, row: np.ndarray, sign: int | np.ndarray) -> None:
        c = check(items)
        for at in self.places(items, row):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, items)
            np.bitwise_xor.at(self.chk, at, c)

    def rows(self, which: np.ndarray) -> Sketches:
        """Some of the sketches, which all have one size."""
        size = 3 * int(self.third[0]) if len(self.third) else 0
        at = (self.start[which][:, None] + np.arange(size)).ravel()
        return Sketches(self.third[which], np.arange(len(which)) * size, self.count[at], self.key[at], self.chk[at])

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(self.third, self.start, self.count - other.count, self.key ^ other.key, self.chk ^ other.chk)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digests, their rows, +1 or -1 for the side that has them, whether each row came out empty). Uses the sketches up."""
        of_cell = np.repeat(np.arange(len(self.third)), 3 * self.third)
        found, rows, signs = [], [], []
        while True:
            at = np.flatnonzero((np.abs(self.count) == 1) & (check(self.key) == self.chk))
            if not len(at):
                break
            items, row = self.key[at], of_cell[at]
            places = self.places(items, row)
            good = (np.abs(self.count[places]) == 1) & (self.key[places] == items) & (check(items) == self.chk[places])
            first = np.where(good[0], places[0], np.where(good[1], places[1], places[2]))
            mine = (first == at) & (places == at).any(axis=0)  # a digest alone in several cells comes once
            if not mine.any():
                break
            items, row, sign = items[mine], row[mine], self.count[at[mine]]
            found.append(items)
            rows.append(row)
            signs.append(sign)
            self.toggle(items, row, -sign)
        left = (self.count != 0) | (self.key != 0) | (self.chk != 0)
        empty = np.ones(len(self.third), dtype=bool)
        empty[of_cell[left]] = False
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return join(found, np.uint64), join(rows, np.int64), join(signs, np.int64), empty

    def texts(self) -> list[str]:
        """Each sketch's cells as text."""
        cells = np.zeros(len(self.count), dtype=_CELL)
        cells["count"], cells["key"], cells["chk"] = self.count, self.key, self.chk
        packed, size = cells.tobytes(), _CELL.itemsize
        return [base64.b64encode(packed[s * size : (s + 3 * t) * size]).decode() for s, t in zip(self.start.tolist(), self.third.tolist(), strict=True)]


def _flat(lists: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = [lists[i] for i in which.tolist()]
    return (np.concatenate(some) if some else np.zeros(0, np.uint64)), np.repeat(np.arange(len(some)), [len(x) for x in some])


def sketched(lists: list[np.ndarray]) -> list[Sketches]:
    """The sketches of fingerprints, by level."""
    flat = _flat(lists, np.arange(len(lists)))
    return [Sketches.of(*flat, np.full(len(lists), third, dtype=np.int64)) for third in LEVELS]


def differences(left: list[np.ndarray], right: list[np.ndarray], ready: tuple[list[Sketches], list[Sketches]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest lists: (only left, only right), recovered from their fingerprints' sketches or larger ones until they peel."""
    out: list = [None] * len(left)
    sizes = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], dtype=np.int64)
    counts = np.array([len(a) - len(b) for a, b in zip(left, right, strict=True)], dtype=np.int64)
    levels = list(zip(*(ready or (sketched(left), sketched(right))), strict=True))
    work, third = np.arange(len(left)), np.full(len(left), LEVELS[0], dtype=np.int64)
    tries = 0
    while len(work):
        if tries < len(levels):
            a, b = (x.rows(work) for x in levels[tries])
        else:
            third = np.maximum(2 * third, sizes[work] // 2)
            a, b = (Sketches.of(*_flat(x, work), third) for x in (left, right))
        third = a.third
        tries += 1
        items, rows, signs, ok = a.minus(b).peel()
        ok &= np.bincount(rows, weights=signs, minlength=len(work)) == counts[work]
        order = np.argsort(rows, kind="stable")
        items, rows, signs = items[order], rows[order], signs[order]
        ends = np.searchsorted(rows, np.arange(len(work) + 1))
        for k in np.flatnonzero(ok).tolist():
            own, sign = items[ends[k] : ends[k + 1]], signs[ends[k] : ends[k + 1]]
            out[work[k]] = (own[sign > 0], own[sign < 0])
        work, third = work[~ok], third[~ok]
    return out


def likenesses(left: list[np.ndarray], right: list[np.ndarray], ready: tuple[list[Sketches], list[Sketches]] | None = None) -> list[float]:
    """Shared paragraphs of both, from 0 to 1; two texts without any are alike."""
    found = differences(left, right, ready)
    return [1 - (len(x) + len(y)) / n if (n := len(a) + len(b)) else 1.0 for a, b, (x, y) in zip(left, right, found, strict=True)]


def fingerprints(lists: list[np.ndarray], ready: list[Sketches] | None = None) -> list[str]:
    """number of digests : small sketch : larger sketch."""
    return [f"{len(x)}:" + ":".join(t) for x, *t in zip(lists, *(s.texts() for s in ready or sketched(lists)), strict=True)]


def compare(a: str, b: str) -> float | None:
    """The likeness of two stored fingerprints; None if neither of their sketches can settle it, as too many paragraphs differ."""
    (n, *own), (m, *other) = a.split(":"), b.split(":")
    total, more = int(n) + int(m), int(n) - int(m)
    for third, x, y in zip(LEVELS, own, other, strict=True):
        both = []
        for t in (x, y):
            cells = np.frombuffer(base64.b64decode(t), _CELL)
            both.append(Sketches(np.array([third]), np.array([0]), cells["count"].astype(np.int64), cells["key"].astype(np.uint64), cells["chk"].astype(np.uint64)))
        items, _, signs, ok = both[0].minus(both[1]).peel()
        if ok[0] and signs.sum() == more:
            return 1 - len(items) / total if total else 1.0
    return None


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points give way to the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "n_paragraphs": pa.int64()}
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long"


def _block(ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """Documents in order against their edited texts and the next ones; ``texts`` has one more, the last one's next."""
    new = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    lists, changed = [digests(t) for t in texts], [digests(t) for t in new]
    all_of, of_new = sketched(lists), sketched(changed)
    at = np.arange(len(ids))
    own, following = ([x.rows(k) for x in all_of] for k in (at, at + 1))
    values = (
        ids, [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in new], fingerprints(lists[:-1], own), fingerprints(changed, of_new),
        likenesses(lists[:-1], changed, (own, of_new)), likenesses(lists[:-1], lists[1:], (own, following)), [len(x) for x in lists[:-1]],
    )
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, _OUT.values(), strict=True)], names=list(_OUT))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges in order, each range's documents in order and then the first document of the next one, which only lends its text."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for halo, i, text in zip(*(batch[c].to_pylist() for c in ("halo", "id", "text")), strict=True):
            if ids and (halo or len(ids) >= BLOCK or size > CHARS):
                yield _block(ids, [*texts, text])
                ids, texts, size = [], [], 0
            if not halo:
                ids.append(i)
                texts.append(text)
                size += len(text)
    release()


def fingerprint_versions(docs: DataFrame, group_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)`` and of their edited texts, and likenesses to these and to the next documents.

    Texts go once to ranges of doc_id, whose tasks read them in order; each range also gets the first document of the next one,
    and the last range that of the first. Null text: empty, no paragraphs. Equal doc_ids go in order of their texts' hashes, so that
    many are dealt to several tasks; a null one comes first. Rows that repeat an id and a text follow each other. A single document
    is its own next. Very long texts are compared alone. Empty table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    tie = F.xxhash64(text)
    ranges = range_groups(docs, group_bytes, tie)
    # the hash's order is that of its unsigned value, as in the ranges
    dealt = docs.select(id_or_first().alias("id"), text.alias("text"), tie.bitwiseXOR(F.lit(-(2**63))).alias("tie"), ranges.group.alias("g"), F.lit(False).alias("halo"))
    firsts = sorted((r["g"], r["first"]["id"], r["first"]["tie"]) for r in dealt.groupBy("g").agg(F.min(F.struct("id", "tie")).alias("first")).collect())  # one row per range
    if not firsts:
        return spark.createDataFrame([], _SCHEMA)
    wanted = [(i, t, firsts[k - 1][0]) for k, (_, i, t) in enumerate(firsts)]
    halo = spark.createDataFrame(wanted, "id long, tie long, g int")
    small = F.broadcast(halo) if len(wanted) < 1 << 18 else halo  # twenty bytes a range
    ahead = dealt.drop("g", "halo").join(small, ["id", "tie"]).groupBy("g", "id", "tie").agg(F.min("text").alias("text")).withColumn("halo", F.lit(True))
    ordered = dealt.unionByName(ahead).repartition(shuffle_partitions(spark), "g").sortWithinPartitions("g", "halo", "id", "tie", "text")
    out = ordered.select("halo", "id", "text").mapInArrow(_compare, _SCHEMA)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(NO_ID), F.col("doc_id")))
