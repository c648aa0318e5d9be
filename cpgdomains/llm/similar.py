"""All pairs of texts whose shingle sets have a Jaccard similarity of ``least`` or more, beside links that are known already.

Nothing here is sampled or capped: each step drops only what can't be in such a pair. A set of n shingles shares at least
``least`` times n with any partner, so it may lack ``spare(n)`` of them.

1. Half of all shingles, chosen by a bit of their hash, are counted by hash: a text with more than its spare shingles in no other
   text goes. That leaves few texts, and only theirs are kept as sets; equal sets of one class are one.
2. All shingles of what is left are counted, now as shared only where a text with another label has them: what the known links
   have joined goes as well.
3. Of the rest, shingles are put in order, rarest first and those that no other label has before all, and each text's first
   ``spare(n) + 1`` taken. Two partners share so many of these that what follows can add up to the similarity.
4. Pairs that do make up groups of two runs of texts, within which all intersections are counted.

Steps 1 and 2 count by 32 bits of the hashes and a piece, which can only keep more; the others use all 64. What a piece finds goes
to a fixed number of homes of texts, a row to each, so rows follow pieces. They hold a count per text that has shared shingles there:
with more pieces more of them, but never more than there are shared shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, shuffle_partitions

#: Shingles that a task sorts at once, about, and that a worker holds before it deals them.
TOKENS, HELD = 1 << 19, 1 << 18
#: Texts of a run and the shingles they have together, about (a longer text is a run of its own); places up to which a shingle's pairs are counted singly.
#: Texts up to which what is known of them goes to every task, 16 bytes each, instead of whole texts through a shuffle.
RUN, RUN_TOKENS, FEW, SENT = 512, 1 << 19, 16, 1 << 18
#: Homes in which what the pieces find of each text is added up, and texts of one at most, about, 16 bytes each: beyond 64 million texts there are more homes.
HOMES, HOME = 64, 1 << 20
#: First shingles of a piece in which pairs are counted, about, and pairs that a worker counts at once.
FIRSTS, MOST_PAIRS = 1 << 21, 1 << 23

_COLUMNS = ("hashes", "rows", "labels", "sizes", "times")
_DEALT = "piece int, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``size``-word shingles, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i : i + size])) for i in range(max(1, len(words) - size + 1))], dtype="<u8"))


def least_forest(links: np.ndarray, n: int) -> np.ndarray:
    """Which of the (2, m) links, in ascending order of weight, make up a least spanning forest of n nodes: Boruvka's rounds.

    Each tree takes its first link that leaves it; as the order has no ties, these close no circle.
    """
    m = links.shape[1]
    label, chosen, alive = np.arange(n), np.zeros(m, dtype=bool), np.arange(m)
    while True:
        a, b = label[links[0, alive]], label[links[1, alive]]
        apart = a != b
        alive, a, b = alive[apart], a[apart], b[apart]
        if not len(alive):
            return np.flatnonzero(chosen)
        first = np.full(n, m)
        np.minimum.at(first, a, alive)
        np.minimum.at(first, b, alive)
        roots = np.flatnonzero(first < m)
        took = first[roots]
        chosen[took] = True
        x, y = label[links[0, took]], label[links[1, took]]
        up = np.arange(n)
        up[roots] = np.where(x == roots, y, x)
        top = roots[(up[up[roots]] == roots) & (roots < up[roots])]  # two trees that took the same link
        up[top] = top
        while not (up[up] == up).all():
            up = up[up]
        label = up[label]


def spare(n: int, least: float) -> int:
    """How many of its ``n`` shingles a text may have that a partner lacks."""
    return int(n - np.ceil(least * n - 1e-9 * max(n, 1)))


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte, all first ones before all second ones: what repeats packs well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(blobs: list[bytes], kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(b, np.uint8).reshape(size, -1).T.copy().view(kind).ravel() for b in blobs)])


def _piece(hashes: np.ndarray, pieces: int) -> np.ndarray:
    return ((hashes >> np.uint64(1) & np.uint64((1 << 31) - 1)) % np.uint64(pieces)).astype(np.int32)


def _deal(piece: np.ndarray, **columns: np.ndarray | None) -> pa.RecordBatch:
    """A row per piece, with its part of each column."""
    by = np.argsort(piece, kind="stable")
    at, cuts = np.unique(piece[by], return_index=True)
    cuts = [*cuts.tolist(), len(by)]
    blobs = [[b"" if columns.get(c) is None else _planes(columns[c][by[i:j]]) for i, j in zip(cuts, cuts[1:], strict=False)] for c in _COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], names=["piece", *_COLUMNS])


def _column(rows: pa.Table, name: str, kind: str = "<i8") -> np.ndarray:
    return _unplanes(rows[name].to_pylist(), kind)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
    return starts, np.diff([*starts.tolist(), len(values)]) if len(starts) else starts


def _counted(sets, pieces: int, least: float):
    """Deals the shingles of each (row, label or None, size, set) that ``sets(batch)`` yields, and how many of these each text must share."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int | None, int, np.ndarray]] = []
        size = turn = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows, labels, sizes, tokens = zip(*held, strict=True)
                ids, each = np.array(rows, "<i8"), [len(t) for t in tokens]
                needs = np.array([max(0, k - spare(n, least)) for n, k in zip(sizes, each, strict=True)], "<u4")
                yield _deal(np.full(len(ids), -1 - turn % pieces, np.int32), rows=ids, times=needs)
                if sum(each):
                    all_of = np.concatenate(tokens)
                    with_labels = None if labels[0] is None else np.repeat(np.array(labels, "<i8"), each)
                    yield _deal(_piece(all_of, pieces), hashes=(all_of >> np.uint64(32)).astype("<u4"), rows=np.repeat(ids, each), labels=with_labels)

        for batch in batches:
            for row, label, n, tokens in sets(batch):
                if n:
                    held.append((row, label, n, tokens))
                    size += len(tokens) + 8
                if size > HELD:
                    yield from flush()
                    held, size, turn = [], 0, turn + 1
        yield from flush()
        release()

    return f


def _half_sets(words: int):
    def f(batch: pa.RecordBatch):
        for row, text in zip(batch["row"], batch["text"], strict=True):
            found = shingle_set(text.as_py(), words)
            yield row.as_py(), None, len(found), found[found & np.uint64(1) == 0]

    return f


def _known_sets(batch: pa.RecordBatch):
    for row, label, blob in zip(batch["row"], batch["label"], batch["shingles"], strict=True):
        found = np.frombuffer(blob.as_py(), "<u8")
        yield row.as_py(), label.as_py(), len(found), found


def _shared(homes: int):
    """To the homes of the texts: how many shingles of each some other label has too, or, below zero, how many of them it must share."""

    def f(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids = _column(rows, "rows")
        if key[0].as_py() < 0:
            n = -_column(rows, "times", "<u4").astype("<i4")
        else:
            hashes, labels = _column(rows, "hashes", "<u4"), _column(rows, "labels")
            by = np.argsort(hashes, kind="stable")
            hashes, ids = hashes[by], ids[by]
            labels = labels[by] if len(labels) else ids
            starts, times = _runs(hashes)
            several = np.minimum.reduceat(labels, starts) != np.maximum.reduceat(labels, starts)
            ids, n = np.unique(ids[np.repeat(several, times)], return_counts=True)
            del hashes, labels, by
        dealt = _deal((ids % homes).astype(np.int32), rows=ids, times=n.astype("<i4"))
        release()
        return pa.Table.from_batches([dealt])

    return f


def _enough(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row) of a home's texts that share as many shingles as they must; what the pieces found is added up batch by batch."""
    known, left = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        ids, n = _column(rows, "rows"), _column(rows, "times", "<i4")
        known, back = np.unique(np.concatenate([known, ids]), return_inverse=True)
        left = np.bincount(back, weights=np.concatenate([left, n]), minlength=len(known)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(known[left >= 0], pa.int64())], names=["row"])
    release()


def _within(dealt: DataFrame, homes: int) -> DataFrame:
    """(row) of the texts whose lone shingles don't exceed what they may lack."""
    return dealt.groupBy("piece").applyInArrow(_shared(homes), _DEALT).groupBy("piece").applyInArrow(_enough, "row long")


def _sets(words: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                found = [shingle_set(t.as_py(), words) for t in part["text"]]
                blobs = [x.tobytes() for x in found]
                least_of = [int(x[0].astype("<i8")) if len(x) else 0 for x in found]
                more = [pa.array(least_of, pa.int64()), pa.array([xxhash.xxh3_128_digest(b) for b in blobs], pa.binary()), pa.array([len(x) for x in found], pa.int64()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays([part["row"], part["fp"], *more], names=["row", "fp", "least", "digest", "n", "shingles"])
        release()

    return f


def _all_shingles(pieces: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                found = [np.frombuffer(b.as_py(), "<u8") for b in part["shingles"]]
                each, tokens = [len(x) for x in found], np.concatenate(found)
                yield _deal(_piece(tokens, pieces), hashes=tokens, **{k: np.repeat(part[c].to_numpy(), each) for k, c in (("rows", "row"), ("labels", "label"), ("sizes", "n"))})
        release()

    return f


def _rarity(pieces: int):
    """Shingles that differing labels have, with the number of texts that have them, to where their text's others are."""

    def f(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        hashes, ids, labels, sizes = _column(rows, "hashes", "<u8"), *(_column(rows, c) for c in ("rows", "labels", "sizes"))
        by = np.argsort(hashes, kind="stable")
        hashes, ids, labels, sizes = hashes[by], ids[by], labels[by], sizes[by]
        starts, times = _runs(hashes)
        keep = np.repeat(np.minimum.reduceat(labels, starts) != np.maximum.reduceat(labels, starts), times)
        dealt = _deal((ids[keep] % pieces).astype(np.int32), hashes=hashes[keep], rows=ids[keep], labels=labels[keep], sizes=sizes[keep], times=np.repeat(times, times)[keep].astype("<u4"))
        release()
        return pa.Table.from_batches([dealt])

    return f


def _firsts(pieces: int, least: float):
    """Each text's first shingles: those that no other label has come before all and need not be sent."""

    def f(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        hashes, times = _column(rows, "hashes", "<u8"), _column(rows, "times", "<u4")
        ids, labels, sizes = (_column(rows, c) for c in ("rows", "labels", "sizes"))
        by = np.lexsort((hashes, times, ids))
        hashes, ids, labels, sizes = hashes[by], ids[by], labels[by], sizes[by]
        starts, shared = _runs(ids)
        take = np.array([spare(n, least) + 1 - (n - k) for n, k in zip(sizes[starts].tolist(), shared.tolist(), strict=True)], np.int64)
        keep = np.arange(len(ids)) - np.repeat(starts, shared) < np.repeat(take, shared)
        return pa.Table.from_batches([_deal(_piece(hashes[keep], pieces), hashes=hashes[keep], rows=ids[keep], labels=labels[keep], sizes=sizes[keep])])

    return f


def _pairs(pieces: int, least: float):
    """(u, v): pairs of differing labels that share enough first shingles here; of those a pair needs, some piece has its part or more."""

    def f(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        hashes, ids, labels, sizes = _column(rows, "hashes", "<u8"), *(_column(rows, c) for c in ("rows", "labels", "sizes"))
        by = np.lexsort((ids, hashes))
        hashes, ids, labels, sizes = hashes[by], ids[by], labels[by], sizes[by]
        known, first, member = np.unique(ids, return_index=True, return_inverse=True)
        n_of = sizes[first]
        rest = n_of - np.array([spare(n, least) + 1 for n in n_of.tolist()], np.int64)
        pairs, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            more, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            both, back = np.unique(np.concatenate([pairs, more]), return_inverse=True)
            return both, np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)

        def batch(whole: bool) -> pa.RecordBatch:
            i, j = pairs // len(known), pairs % len(known)
            need = np.ceil(least / (1 + least) * (n_of[i] + n_of[j]) - 1e-6).astype(np.int64) - np.maximum(rest[i], rest[j])
            keep = whole | (counts * pieces >= need)
            return pa.RecordBatch.from_arrays([pa.array(known[x[keep]], pa.int64()) for x in (i, j)], names=["u", "v"])

        for start in range(0, len(hashes), HELD):
            at, d = np.arange(start, min(start + HELD, len(hashes))), 0
            while len(at):
                d += 1
                at = at[at + d < len(hashes)]
                at = at[hashes[at] == hashes[at + d]]
                low, high = np.minimum(sizes[at], sizes[at + d]), np.maximum(sizes[at], sizes[at + d])
                some = at[(labels[at] != labels[at + d]) & (low >= least * high - 1e-6)]
                held.append(member[some] * len(known) + member[some + d])
                size += len(some)
                if size > 4 * HELD:
                    pairs, counts = fold()
                    held, size = [], 0
                    if len(pairs) > MOST_PAIRS:  # counts would be cut: all of these go on
                        yield batch(True)
                        pairs, counts = pairs[:0], counts[:0]
        pairs, counts = fold()
        yield batch(False)
        release()

    return f


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements every two of some sets share; only what is right of the diagonal is meant."""
    m = len(sets)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    by = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[by], owner[by]
    _, times = _runs(tokens)
    both = np.zeros(m * m)
    few = np.repeat((times > 1) & (times <= FEW), times)
    o, t = owner[few], tokens[few]
    for d in range(1, FEW):
        same = t[d:] == t[:-d]
        if not same.any():
            break
        both += np.bincount(o[:-d][same] * m + o[d:][same], minlength=m * m)
    both = both.reshape(m, m)
    many = np.repeat(times > FEW, times)
    o, column = owner[many], np.repeat(np.arange((times > FEW).sum()), times[times > FEW])
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        i, j = np.searchsorted(column, [c, c + 2048])
        held = np.zeros((m, 2048), np.float32)
        held[o[i:j], column[i:j] - c] = 1
        both += held @ held.T
    return both


def _compared(least: float, reach: int | None):
    def f(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        fps, labels = rows["fp"].to_numpy(), rows["label"].to_numpy()
        sets = [np.frombuffer(b, "<u8") for b in rows["shingles"].to_pylist()]
        both, n = intersections(sets), np.array([len(x) for x in sets])
        i, j = np.nonzero(np.triu(both >= least * (n[:, None] + n[None, :] - both), 1))
        keep = labels[i] != labels[j]
        if reach is not None:
            keep &= np.bitwise_count(fps.view(np.uint64)[i] ^ fps.view(np.uint64)[j]) <= reach
        links = np.stack([i[keep], j[keep]])
        _, label = np.unique(labels, return_inverse=True)
        links = links[:, least_forest(label[links], len(sets))]  # between labels: what one of these has is joined already
        release()
        return pa.table({"u": pa.array(fps[links[0]], pa.int64()), "v": pa.array(fps[links[1]], pa.int64())})

    return f


def links_between(rows: DataFrame, fps: DataFrame, labels: DataFrame, least: float, words: int, reach: int | None = None) -> DataFrame:
    """Links (u, v) of fingerprints that join whatever texts of similarity ``least`` or more join and ``labels(fp, label)`` leaves apart.

    ``rows(row, text)`` and ``fps(row, fp)`` hold every text, ``row`` being its own; a fingerprint without a label is one. Every
    text is compared, not one for each fingerprint. ``reach``: only links of at most that many differing bits.
    """
    spark = rows.sparkSession
    size, texts = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    homes = lambda n: max(HOMES, -(-n // HOME))
    pieces = lambda tokens: max(shuffle_partitions(spark), -(-tokens // TOKENS))
    n = pieces(size // 12)  # about six bytes a word, half of the shingles
    shared = materialise(_within(rows.select("row", "text").mapInArrow(_counted(_half_sets(words), n, least), _DEALT), homes(texts)), "shared")
    some = materialise(shared.join(fps.select("row", "fp"), "row"), "shared")
    texts = some.count()
    sets = materialise(rows.select("row", "text").join(F.broadcast(some) if texts <= SENT else some, "row").select("row", "fp", "text").mapInArrow(_sets(words), "row long, fp long, least long, digest binary, n long, shingles binary"), "sets")
    own = sets.groupBy("fp", "digest").agg(F.min("row").alias("row"))
    own = materialise(own.join(labels, "fp", "left").select("row", F.coalesce("label", "fp").alias("label")), "own")
    known = sets.drop("digest").join(own, "row")
    tokens_of = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = pieces(tokens_of(sets))
    left = materialise(_within(known.select("row", "label", "shingles").mapInArrow(_counted(_known_sets, n, least), _DEALT), homes(texts)), "left")
    known = materialise(known.join(left, "row"), "left")
    n = pieces(tokens_of(known))
    rare = known.select("row", "label", "n", "shingles").mapInArrow(_all_shingles(n), _DEALT).groupBy("piece").applyInArrow(_rarity(n), _DEALT)
    few = max(1, -(-int((1 - least) * tokens_of(known)) // FIRSTS))
    firsts = rare.groupBy("piece").applyInArrow(_firsts(few, least), _DEALT)
    pairs = materialise(firsts.groupBy("piece").applyInArrow(_pairs(few, least), "u long, v long").distinct(), "pairs")
    # runs of the texts that are left, alike ones (by their least shingle) together
    place = F.pmod(F.xxhash64("least"), F.lit(-(-known.count() // RUN) or 1))
    near = Window.partitionBy("place").orderBy("least", "row")
    upto = F.sum("n").over(near.rowsBetween(Window.unboundedPreceding, 0))
    run = ((F.row_number().over(near) - 1) / RUN).cast("long") + (upto / RUN_TOKENS).cast("long")
    runs = materialise(known.select("row", "n", "least", place.alias("place")).select("row", (F.shiftleft("place", 32) + run).alias("run")), "runs")
    for end in ("u", "v"):
        pairs = pairs.join(runs.select(F.col("row").alias(end), F.col("run").alias(f"{end}_run")), end)
    ends = [pairs.select(F.least("u_run", "v_run").alias("a"), F.greatest("u_run", "v_run").alias("b"), F.col(end).alias("row")) for end in ("u", "v")]
    met = materialise(ends[0].unionByName(ends[1]).distinct(), "met")
    return met.join(known.select("row", "fp", "label", "shingles"), "row").groupBy("a", "b").applyInArrow(_compared(least, reach), "u long, v long")
