"""SimHash near-dedup by a binary trie self-join.

Texts of one fingerprint form a class, so copies meet once. The classes' fingerprints, with their bits put in order of
balance, form a binary trie. Its top is split from counts of prefixes until a leaf holds few fingerprints, and grows with their
number; the driver knows fingerprints only as counts. Each leaf traverses that top for the leaves within the error budget
and goes to their tasks. A task gets one leaf with some of its partners, at most about ``TOGETHER`` fingerprints however many there
are in all, and goes on down the trie, all node pairs of a level at once: equal bits keep the error, differing bits add one,
and a pair over the budget is dropped. Tasks return spanning links of what they find, and components grow over these links by
alternating large and small stars, on disk between rounds.

Where links must pass a check of the texts, spanning links of the unchecked pairs only give the first components. The trie is
then joined again, and every pair whose ends these leave apart is checked, in groups of at most two times ``CHUNK``
fingerprints; within a group a pair is passed over only if links that have passed join its ends already. What the trie's orders
don't find, an exact search of the texts' shingle sets adds (``similar.links_between``), for all texts that these links leave apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, id_or_first, materialise, numbered, release, shuffle_partitions, text_bytes
from .similar import least_forest, links_between, shingle_set

_U = np.uint64
#: Seed of the shingle hashes, and levels of the trie's top at most: 12 bytes a leaf go to every task.
SEED, TOP_BITS = 42, 20
#: Fingerprints that a task joins at once, about 200 bytes each, and those of a leaf while the top can grow.
TOGETHER, LEAF = 1 << 18, 1 << 14
#: Fingerprints on either side of a group whose pairs are checked together.
CHUNK = 512


def fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash of the ``size``-word shingles of a text, repeats included; fewer words make one shingle, none gives 0."""
    words = text.lower().split()  # bytes: only A-Z and ASCII white space are meant
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), dtype=np.uint64, count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(size: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), size) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array(values, pa.int64())], names=["doc_id", "row", "fp"])
        release()

    return f


def _rows(docs: DataFrame, row: str | None) -> DataFrame:
    own = F.lit(0) if row is None else F.col(row)
    return docs.select(id_or_first().alias("doc_id"), own.cast("long").alias("row"), text_bytes().alias("text"))


def fingerprints(docs: DataFrame, size: int = 3, row: str | None = None) -> DataFrame:
    """(doc_id, row, fp) of every row; fp is the unsigned fingerprint as a signed long. Null text: empty. Null doc_id: the smallest."""
    return _rows(docs, row).mapInArrow(_fingerprints(size), "doc_id long, row long, fp long")


def permute(values: np.ndarray, order: list[int]) -> np.ndarray:
    """Bit order[0] becomes the highest, and so on."""
    values = values.view(np.uint64)
    out = np.zeros(len(values), dtype=np.uint64)
    for k, bit in enumerate(order):
        out |= (values >> _U(bit) & _U(1)) << _U(63 - k)
    return out


def split_top(counts: dict[int, int], bits: int, most: int) -> list[tuple[int, int]]:
    """(prefix, depth) of the leaves of the trie's top: nodes of at most ``most`` fingerprints, or at ``bits``."""
    leaves = []
    work = [(0, 0, sorted(counts.items()))]
    while work:
        prefix, depth, cells = work.pop()
        if depth == bits or sum(n for _, n in cells) <= most:
            leaves.append((prefix, depth))
            continue
        for bit in (0, 1):
            if below := [(p, n) for p, n in cells if p >> (bits - depth - 1) & 1 == bit]:
                work.append((prefix << 1 | bit, depth + 1, below))
    return sorted(leaves, key=lambda x: x[0] << (64 - x[1]))


def schedule(budget: int, start: int | None = None, levels: int = 17, step: int = 5) -> list[int]:
    """Errors allowed within the first 0..64 bits: ``budget`` throughout, or ``start`` for some levels and then one more per ``step``."""
    if start is None:
        return [budget] * 65
    return [min(budget, start + max(0, -(-(d - levels) // step))) if d < 64 else budget for d in range(65)]


def partners(i: int, starts: np.ndarray, depths: np.ndarray, budgets: list[int]) -> list[int]:
    """The leaves within the budgets of leaf ``i`` on the bits that both have, itself included: traversal of the top.

    ``starts``: the leaves' smallest values, ascending.
    """
    own, end = int(starts[i]), int(depths[i])
    out, work = [], [(0, len(starts), 0, 0)]
    while work:
        lo, hi, bit, err = work.pop()
        if lo == hi or err > budgets[bit]:
            continue
        if bit == end or hi - lo == 1 and depths[lo] <= bit:  # one has no more bits: all leaves below the other are its partners
            out += range(lo, hi)
            continue
        upper = (int(starts[lo]) >> (64 - bit) << 1 | 1) << (63 - bit)
        mid = lo + int(np.searchsorted(starts[lo:hi], _U(upper)))
        mine = own >> (63 - bit) & 1
        work += [(lo, mid, bit + 1, err + mine), (mid, hi, bit + 1, err + 1 - mine)]
    return sorted(out)


def trie_join(values: np.ndarray, home: tuple[int, int], budgets: list[int], most: int = 1 << 18, within: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct ``values`` within ``budgets[64]`` bits, one of each pair in home = (start, end), the other not before it.

    ``budgets[d]`` bounds the errors within the first d bits; one number throughout finds every pair. ``within``: pairs of
    two home values come too.

    Node pairs (ranges of values that share a prefix) go down level by level; at most about ``most`` are expanded at once.
    """
    s, e = home
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate([np.zeros(1, np.int32), np.cumsum(values >> _U(63 - bit) & _U(1), dtype=np.int32)])
        return hi - (ones[bit][hi] - ones[bit][lo])

    work = [(0, np.array([s, s]), np.array([e, e]), np.array([s, e]), np.array([e if within else s, len(values)]), np.array([0, 0]))]
    while work:
        bit, a, b, c, d, err = work.pop()
        keep = (a < b) & (c < d) & (err <= budgets[bit])
        a, b, c, d, err = (x[keep] for x in (a, b, c, d, err))
        same = (a == c) & (b == d)
        keep = ~(same & (b - a == 1))
        a, b, c, d, err, same = (x[keep] for x in (a, b, c, d, err, same))
        single = (b - a == 1) & (d - c == 1)  # two leaves: all their remaining bits at once
        if single.any():
            i, j = a[single], c[single]
            near = np.bitwise_count(values[i] ^ values[j]) <= budgets[64]
            if near.any():
                yield i[near], j[near]
            a, b, c, d, err, same = (x[~single] for x in (a, b, c, d, err, same))
        if not len(a) or bit == 64:
            continue
        if len(a) > most:
            half = len(a) // 2
            work += [(bit, *(x[:half] for x in (a, b, c, d, err))), (bit, *(x[half:] for x in (a, b, c, d, err)))]
            continue
        m, n = split(a, b, bit), split(c, d, bit)
        other = ~same
        parts = [(a, m, c, n, err), (m, b, n, d, err), (a, m, n, d, err + 1), (m[other], b[other], c[other], n[other], err[other] + 1)]
        work.append((bit + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def _deal(order: list[int], starts: np.ndarray):
    """A batch's fingerprints and their labels by leaf: at most a row per fingerprint."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = permute(batch["fp"].to_numpy(), order)
            by = np.argsort(values)
            values, labels = values[by], batch["label"].to_numpy()[by]
            leaves, cuts = np.unique(np.searchsorted(starts, values, side="right") - 1, return_index=True)
            cuts = [*cuts.tolist(), len(values)]
            blobs = [[x[i:j].astype(kind).tobytes() for i, j in zip(cuts, cuts[1:], strict=False)] for x, kind in ((values, "<u8"), (labels, "<i8"))]
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], names=["leaf", "values", "labels"])

    return f


def _spread(starts: np.ndarray, depths: np.ndarray, budgets: list[int], pieces: int):
    """A whole leaf, once for each task that needs it: a piece of each partner before it, and all pieces of its own."""

    def f(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, rows = key[0].as_py(), pa.Table.from_batches(list(batches))
        to = [(i, leaf % pieces) for i in partners(leaf, starts, depths, budgets) if i < leaf] + [(leaf, p) for p in range(pieces)]
        blobs = [b"".join(rows[k].to_pylist()) for k in ("values", "labels")]
        for i in range(0, len(to), 64):
            some = to[i : i + 64]
            at = [pa.array([x[k] for x in some], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*at, *(pa.array([b] * len(some), pa.binary()) for b in blobs)], names=["home", "piece", "values", "labels"])

    return f


def _joined(starts: np.ndarray, budgets: list[int], key: tuple, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """(values, labels, pairs) of a leaf with some of its partners."""
    home, piece = (k.as_py() for k in key)
    values, labels = (np.concatenate([np.frombuffer(b, kind) for b in rows[k].to_pylist()]) for k, kind in (("values", "<u8"), ("labels", "<i8")))
    by = np.argsort(values)
    values, labels = values[by], labels[by]
    s = int(np.searchsorted(values, starts[home]))
    e = len(values) if home + 1 == len(starts) else int(np.searchsorted(values, starts[home + 1]))
    return values, labels, trie_join(values, (s, e), budgets, within=piece == 0)


def _plain(values: np.ndarray, order: list[int]) -> np.ndarray:
    """Undoes ``permute``."""
    return permute(values, [63 - order.index(63 - k) for k in range(64)]).view(np.int64)


def _links(order: list[int], starts: np.ndarray, budgets: list[int]):
    def f(key, rows):
        values, _, pairs = _joined(starts, budgets, key, rows)
        u, v = spanning_pairs(values, pairs)
        plain = _plain(values, order)
        return pa.table({"u": pa.array(plain[u], pa.int64()), "v": pa.array(plain[v], pa.int64())})

    return f


def _groups(order: list[int], starts: np.ndarray, budgets: list[int], chunk: int):
    """Who meets whom: of each two runs of ``chunk`` labelled values the members that have a partner with another label there."""

    def f(key, rows):
        home, piece = (k.as_py() for k in key)
        values, labels, pairs = _joined(starts, budgets, key, rows)
        n = len(values)
        run = np.cumsum(labels != NO_ID) // chunk
        found = np.zeros(0, dtype=np.int64)
        for i, j in pairs:
            apart = labels[i] != labels[j]
            i, j = i[apart], j[apart]
            group = run[i] * (n + 1) + run[j]
            found = np.unique(np.concatenate([found, group * n + i, group * n + j]))
        group, member = found // max(n, 1), found % max(n, 1)
        return pa.table({"home": pa.array([home] * len(found), pa.int32()), "piece": pa.array([piece] * len(found), pa.int32()), "part": pa.array(group, pa.int64()), "fp": pa.array(_plain(values, order)[member], pa.int64())})

    return f


def spanning_pairs(values: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A forest of least distances over the pairs: fewer links than values, and no path of it has a longer link than a pair it joins.

    Pairs come in portions; the forest so far stands for those before.
    """
    kept = np.zeros((2, 0), dtype=np.int64)
    held: list[np.ndarray] = []
    size = 0

    def fold() -> np.ndarray:
        both = np.concatenate([kept, *held], axis=1)
        both = both[:, np.argsort(np.bitwise_count(values[both[0]] ^ values[both[1]]), kind="stable")]
        return both[:, least_forest(both, len(values))]

    for i, j in pairs:
        held.append(np.stack([i, j]))
        size += len(i)
        if size > 1 << 20:
            kept, held, size = fold(), [], 0
    return tuple(fold()) if held else tuple(kept)


def bit_order(classes: DataFrame) -> list[int]:
    """The bits of the distinct fingerprints of ``classes(fp)`` by balance."""
    counted = classes.agg(F.count(F.lit(1)), *(F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1))) for k in range(64))).first()
    return sorted(range(64), key=lambda k: (abs(2 * (counted[k + 1] or 0) - counted[0]), k))


def in_turn(order: list[int], turn: int) -> list[int]:
    """The order itself, or a fixed shuffle of it for each ``turn`` above 0."""
    return [order[k] for k in np.random.default_rng(turn).permutation(64).tolist()] if turn else order


def trie_tasks(classes: DataFrame, order: list[int], budgets: list[int], leaf: int | None, task, schema: str) -> DataFrame:
    """``task(order, starts, budgets)`` on each leaf of the trie of ``classes(fp, label)`` with its partners; fp are distinct."""
    spark = classes.sparkSession
    n = classes.count()
    if n < 2:
        return spark.createDataFrame([], schema)
    leaf = leaf or max(512, min(LEAF, n // (16 * shuffle_partitions(spark))), n >> TOP_BITS)
    bits = min(TOP_BITS, max(1, (4 * n // leaf).bit_length()))
    prefix = sum((F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)) * F.lit(1 << (bits - 1 - k)) for k, b in enumerate(order[:bits])), F.lit(0).cast("long"))
    counted = classes.groupBy(prefix.alias("p")).count().toArrow()  # at most 2 ** TOP_BITS rows
    leaves = split_top(dict(zip(counted["p"].to_pylist(), counted["count"].to_pylist(), strict=True)), bits, leaf)
    starts = np.array([p << (64 - d) if d else 0 for p, d in leaves], dtype=np.uint64)
    depths = np.array([d for _, d in leaves], dtype=np.int32)
    near = sum(comb(bits, k) for k in range(min(bits, budgets[bits]) + 1))  # partners of a leaf at most, if all leaves are as deep
    pieces = max(1, -(-min(n, near * leaf) // TOGETHER))
    blobs = "values binary, labels binary"
    dealt = classes.select("fp", "label").mapInArrow(_deal(order, starts), f"leaf int, {blobs}").groupBy("leaf").applyInArrow(_spread(starts, depths, budgets, pieces), f"home int, piece int, {blobs}")
    return dealt.groupBy("home", "piece").applyInArrow(task(order, starts, budgets), schema)


def trie_links(classes: DataFrame, order: list[int], budgets: list[int], leaf: int | None = None) -> DataFrame:
    """Links (u, v) between the distinct fingerprints of ``classes(fp)``: pairs within the budgets, as least spanning forests.

    A fingerprint has at most 2080 others within two bits.
    """
    return trie_tasks(classes.select("fp", F.lit(0).cast("long").alias("label")), order, budgets, leaf, _links, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of undirected links (u, v); component is the smallest node reachable. Nodes without links are absent.

    Large-star and small-star rounds until nothing changes; each round is written to the shared folder.
    """
    pairs = lambda df: df.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = materialise(pairs(links), "links")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(state)
    while before[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = pairs(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        state = materialise(pairs(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))), "links")
        after = mark(state)
        if after == before:
            break
        before = after
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _shingles(size: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                sets = [shingle_set(t.as_py(), size).tobytes() for t in part["text"]]
                yield pa.RecordBatch.from_arrays([part["fp"], pa.array(sets, pa.binary())], names=["fp", "shingles"])

    return f


def _alike(least: float):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["a"], batch["b"], strict=True):
                a, b = (np.frombuffer(z.as_py(), "<u8") for z in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(both >= least * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return f


def shingles_of(links: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(fp, shingles) of the links' ends: the ``size``-word shingles of the classes' first rows in ``docs(doc_id, row, text)``."""
    wanted = links.select(F.col("u").alias("fp")).unionByName(links.select(F.col("v").alias("fp"))).distinct()
    first = classes.join(wanted, "fp", "left_semi").select("fp", "first.doc_id", "first.row")
    texts = docs.join(first, ["doc_id", "row"])
    return materialise(texts.select("fp", "text").mapInArrow(_shingles(size), "fp long, shingles binary"), "shingles")


def verified(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those links whose ends have a Jaccard similarity of ``least`` or more in ``sets(fp, shingles)``."""
    a, b = (sets.select(F.col("fp").alias(k), F.col("shingles").alias(n)) for k, n in (("u", "a"), ("v", "b")))
    return links.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_alike(least), "u long, v long")


def alike_forest(fps: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], reach: int, least: float) -> list[tuple[int, int]]:
    """Index pairs within ``reach`` bits with a similarity of ``least`` or more; one is left out only if labels and others join its ends."""
    _, up = np.unique(labels, return_inverse=True)
    up = up.copy()  # the tree of each member, at all times
    near = []
    for i in range(len(fps) - 1):
        bits = np.bitwise_count(fps[i] ^ fps[i + 1 :])
        j = np.flatnonzero((bits <= reach) & (up[i] != up[i + 1 :]))
        near.append(np.stack([bits[j].astype(np.int64), np.full(len(j), i), i + 1 + j]))
    if not near:
        return []
    pairs = np.concatenate(near, axis=1)
    out = []
    for i, j in pairs[1:, np.argsort(pairs[0], kind="stable")].T.tolist():
        a, b = sets[i], sets[j]
        if up[i] == up[j] or min(len(a), len(b)) < least * max(len(a), len(b)):
            continue
        both = len(np.intersect1d(a, b, assume_unique=True))
        if both >= least * (len(a) + len(b) - both):
            out.append((i, j))
            up[up == up[j]] = up[i]
    return out


def _checked(reach: int, least: float):
    def f(key, rows):
        fps = rows["fp"].to_numpy()
        sets = [np.frombuffer(b, "<u8") for b in rows["shingles"].to_pylist()]
        found = alike_forest(fps.view(np.uint64), rows["label"].to_numpy(), sets, reach, least)
        u, v = (fps[[p[k] for p in found]] for k in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return f


def near_copies(docs: DataFrame, classes: DataFrame, order: list[int], leaf: int | None, similar: float, words: int, reach: int, turns: int, start: int | None = 2, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) that join whatever the links of similarity ``similar`` or more join, of all pairs within ``reach`` bits that some turn finds."""
    budgets = schedule(reach, start)
    far = trie_links(classes, order, budgets, leaf)
    for turn in range(1, turns):
        far = far.unionByName(trie_links(classes, in_turn(order, turn), budgets, leaf))
    far = materialise(far.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")
    sets = shingles_of(far, docs, classes, words)
    links = materialise(verified(far, sets, similar), "verified")
    # the same join once more, as it has the same values; all its pairs' ends are in a spanning forest, so they have shingles and labels
    found = components(links).withColumnRenamed("node", "fp").withColumnRenamed("component", "label")
    labels = sets.select("fp").join(found, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))
    members = materialise(classes.select("fp").join(labels, "fp", "left").select("fp", F.coalesce("label", F.lit(NO_ID)).alias("label")), "members")
    for turn in range(turns):
        task = lambda order, starts, budgets: _groups(order, starts, budgets, chunk)
        groups = trie_tasks(members, in_turn(order, turn), budgets, leaf, task, "home int, piece int, part long, fp long").withColumn("turn", F.lit(turn))
        met = groups if not turn else met.unionByName(groups)
    met = materialise(met, "groups").join(members, "fp").join(sets, "fp")
    return links.unionByName(met.groupBy("turn", "home", "piece", "part").applyInArrow(_checked(reach, similar), "u long, v long"))


def simhash_dedup(
    docs: DataFrame, size: int = 3, budget: int = 2, leaf: int | None = None, similar: float | None = None, words: int = 5, reach: int = 10, turns: int = 4,
    exact: bool = False, row: str | None = None, beyond: bool = False,
) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), and, if a column
    ``row`` is named, that column and ``first``, true for one row of each component.

    Fingerprints link at ``budget`` or fewer differing bits. With ``similar``, those at up to ``reach`` bits link instead, if the
    texts' exact Jaccard similarity on ``words``-word shingles is at least that, and with ``beyond`` those of that similarity at any
    number of bits. They are sought in ``turns`` orders of the bits, with two errors allowed in the trie's top and more below;
    whatever these miss is found by an exact search of shingle sets, so that no link is left out. ``exact`` allows all errors
    everywhere: the trie alone then finds every pair within ``reach`` bits, in one order, at a cost that grows much faster than
    the input. Texts of one fingerprint are one class, unchecked; in the trie its first row (by doc_id, then ``row``) stands for
    it, in the exact search each of its texts is compared. ``row`` differs between all rows.
    Null or empty text: fingerprint zero, linked like any other. Texts may be of any length; a class, however large, travels as
    one fingerprint. A null doc_id counts as the smallest and is returned as null, so its component's id may be null. Repeated
    rows share a class. Empty table: no rows. Other columns are not read.
    """
    if similar is not None and row is None:
        docs, row = numbered(docs.select("doc_id", "text"), "near")
        return simhash_dedup(docs, size, budget, leaf, similar, words, reach, turns, exact, row, beyond).drop(row, "first")
    rows = materialise(fingerprints(docs, size, row), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("first")), "classes")
    order = bit_order(classes)
    if similar is None:
        links = trie_links(classes, order, schedule(budget), leaf)
    else:
        links = materialise(near_copies(_rows(docs, row), classes, order, leaf, similar, words, reach, 1 if exact else turns, None if exact else 2), "links")
        labels = components(links).select(F.col("node").alias("fp"), F.col("component").alias("label"))
        links = links.unionByName(links_between(_rows(docs, row), rows, labels, similar, words, None if beyond else reach))
    found = components(links)
    labelled = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("head"))
    by_class = labelled.join(smallest, "component").select("fp", "head")
    null = lambda c: F.when(c != F.lit(NO_ID), c)
    out = rows.join(by_class, "fp")
    own = [F.col("row").alias(row), (F.struct("doc_id", "row") == F.col("head")).alias("first")] if row else []
    return out.select(null(F.col("doc_id")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), null(F.col("head.doc_id")).alias("component_id"), *own)
