import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import GroupedData

import corpus_pipeline
from cpgdomains.llm import similar
from cpgdomains.llm import simhash as s

from .data import docs
from .test_simhash import Forest, similarities


def near_texts(rng, groups):
    """Near copies around a similarity of 0.8, short and long, whose fingerprints differ in few bits and in many."""
    texts = []
    for _ in range(groups):
        n = int(rng.integers(20, 300))
        base = [f"v{rng.integers(30_000)}" for _ in range(n)]
        for copy in range(3):
            words = list(base)
            for at in rng.choice(n, int(rng.integers(1, max(2, n // 30))) if copy else 0, replace=False):
                words[at] = f"n{rng.integers(10**9)}"
            texts.append(" ".join(words))
    return texts


def gone_of(texts, linked):
    forest = Forest(len(texts))
    for i, j in zip(*np.nonzero(linked), strict=True):
        forest.join(int(i), int(j))
    return {i for i in range(len(texts)) if forest.root(i) != i}


def test_pipeline_stage_finds_every_near_copy(spark):
    texts = near_texts(np.random.default_rng(31), 400)
    linked = similarities(texts) >= 0.8
    values = np.array([s.fingerprint(t.encode()) for t in texts], dtype=np.uint64)
    bits = np.bitwise_count(values[:, None] ^ values[None, :])
    assert (linked & (bits > 10)).sum() > 20  # beyond the bits that the trie looks at
    wanted = gone_of(texts, linked)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(spark, list(enumerate(texts))), "").select("doc_id").collect()}
    assert set(range(len(texts))) - kept == wanted


def test_every_pair_within_the_bits_is_found(spark):
    texts = near_texts(np.random.default_rng(32), 300)
    values = np.array([s.fingerprint(t.encode()) for t in texts], dtype=np.uint64)
    linked = (similarities(texts) >= 0.8) & (np.bitwise_count(values[:, None] ^ values[None, :]) <= 16)
    found = {r.doc_id: r.component_id for r in s.simhash_dedup(docs(spark, list(enumerate(texts))), similar=0.8, reach=16, turns=1).collect()}
    assert {i for i, c in found.items() if c != i} == gone_of(texts, linked)


def test_each_text_of_a_fingerprint_is_compared(spark):
    base = [f"a{i}" for i in range(100)]
    near = " ".join([*base[:50], "other", *base[51:]])
    rows = spark.createDataFrame([(0, b"something else that comes first"), (1, " ".join(base).encode()), (2, near.encode()), (3, b""), (4, b"")], "row long, text binary")
    fps = spark.createDataFrame([(0, 7), (1, 7), (2, 9), (3, 1), (4, 2)], "row long, fp long")
    none = spark.createDataFrame([], "fp long, label long")
    find = lambda labels, reach=None: {tuple(sorted(r)) for r in similar.links_between(rows, fps, labels, 0.8, 5, reach).collect()}
    assert find(none) == {(7, 9)}
    assert find(none, 3) == {(7, 9)} and find(none, 2) == set()
    assert find(spark.createDataFrame([(7, 7), (9, 7)], "fp long, label long")) == set()  # joined already
    assert similar.links_between(rows.limit(0), fps, none, 0.8, 5).count() == 0


@pytest.mark.parametrize("few", [1, 4, 16])
def test_intersections(monkeypatch, few):
    monkeypatch.setattr(similar, "FEW", few)
    rng = np.random.default_rng(few)
    sets = [np.unique(rng.integers(0, 60, int(n))).astype("<u8") for n in rng.integers(0, 40, 30)]
    both = similar.intersections(sets)
    for j in range(len(sets)):
        for i in range(j):
            assert both[i, j] == len(np.intersect1d(sets[i], sets[j]))
    assert similar.intersections([np.zeros(0, "<u8")] * 2).tolist() == [[0, 0], [0, 0]]


@pytest.mark.parametrize("held", [3, 1 << 20])
def test_pairs_hold_all_alike_ones(monkeypatch, held):
    """Over three pieces, in portions or at once: each pair of 0.8 or more with differing labels comes from one of them."""
    monkeypatch.setattr(similar, "HELD", held)
    monkeypatch.setattr(similar, "MOST_PAIRS", 10 * held)
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 2**63, 40, dtype=np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([base[k % 4][rng.random(40) > 0.06], rng.integers(0, 2**63, int(rng.integers(0, 4)), dtype=np.uint64)])) for k in range(60)]
    labels, sizes = rng.integers(0, 20, 60), np.array([len(x) for x in sets])
    known = pa.RecordBatch.from_pydict({"row": np.arange(60) * 7, "label": labels, "n": sizes, "shingles": pa.array([x.tobytes() for x in sets], pa.binary())})
    grouped = lambda table: [((pa.scalar(k),), table.filter(pa.compute.equal(table["piece"], k))) for k in table["piece"].unique().to_pylist()]
    table = pa.Table.from_batches(similar._all_shingles(3)(iter([known])))
    for step in (similar._rarity(3), similar._firsts(3, 0.8)):
        table = pa.concat_tables([step(*g) for g in grouped(table)])
    found = set()
    for key, part in grouped(table):
        for batch in similar._pairs(3, 0.8)(key, iter(part.to_batches())):
            found |= {(r["u"] // 7, r["v"] // 7) for r in batch.to_pylist()}
    assert all(labels[i] != labels[j] for i, j in found)
    alike = 0
    for j in range(60):
        for i in range(j):
            both = len(np.intersect1d(sets[i], sets[j]))
            if labels[i] != labels[j] and both >= 0.8 * (sizes[i] + sizes[j] - both):
                alike += 1
                assert (i, j) in found
    assert 50 < alike


def grouped(batches):
    table = pa.Table.from_batches(batches)
    return [((pa.scalar(k),), table.filter(pa.compute.equal(table["piece"], k))) for k in table["piece"].unique().to_pylist()]


@pytest.mark.parametrize("labelled", [False, True])
def test_texts_with_too_many_lone_shingles_go(monkeypatch, labelled):
    """Over five pieces, three homes and many portions, those stay that a direct count keeps."""
    monkeypatch.setattr(similar, "HELD", 100)
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 2**63, 40, dtype=np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([base[k % 6][rng.random(40) > 0.3], rng.integers(0, 2**63, int(rng.integers(0, 50)), dtype=np.uint64)])) for k in range(90)]
    sets += [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 1, 3, 30)]
    rows, labels = np.arange(len(sets)) * 7 - 50, rng.integers(0, 60, len(sets)).tolist()
    taken = [x if labelled else x[x & np.uint64(1) == 0] for x in sets]
    have = {}
    for k, x in enumerate(taken):
        for h in x.tolist():
            have.setdefault(h, set()).add(labels[k] if labelled else k)
    wanted = {int(rows[k]) for k, x in enumerate(taken) if len(sets[k]) and sum(len(have[h]) == 1 for h in x.tolist()) <= similar.spare(len(sets[k]), 0.8)}
    yielded = lambda _: [(int(r), labels[k] if labelled else None, len(sets[k]), taken[k]) for k, r in enumerate(rows)]
    dealt = grouped(similar._counted(yielded, 5, 0.8)(iter([None])))
    assert len(dealt) > 5
    made = pa.concat_tables([similar._shared(3)(*g) for g in dealt])
    assert made.num_rows <= 3 * len(dealt)
    found = [r for key, part in grouped(made.to_batches()) for b in similar._enough(key, iter(part.to_batches(max_chunksize=2))) for r in b["row"].to_pylist()]
    assert sorted(found) == sorted(wanted) and 10 < len(wanted) < len(sets) - 10


def test_rows_made_dont_follow_texts_times_pieces(spark, monkeypatch):
    monkeypatch.setattr(similar, "TOKENS", 256)
    monkeypatch.setattr(similar, "HOMES", 4, raising=False)
    made, plain = [], GroupedData.applyInArrow

    def counted(self, func, schema):
        out = plain(self, func, schema)
        made.append(out.count())
        return out

    monkeypatch.setattr(GroupedData, "applyInArrow", counted)
    rng = np.random.default_rng(9)
    texts = near_texts(rng, 6) + [" ".join(f"u{rng.integers(10**9)}" for _ in range(100)) for _ in range(400)]
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "row long, text binary")
    none = spark.createDataFrame([], "fp long, label long")
    links = similar.links_between(rows, rows.selectExpr("row", "row AS fp"), none, 0.8, 5).collect()
    forest = Forest(len(texts))
    for u, v in links:
        forest.join(u, v)
    assert {i for i in range(len(texts)) if forest.root(i) != i} == gone_of(texts, similarities(texts) >= 0.8) != set()
    assert max(made) < 2 * len(texts)  # some 80 pieces, in half of which each text has shingles


def test_spare_shingles_bound_what_a_partner_lacks():
    for n in range(1, 400):
        least = next(k for k in range(n + 1) if k >= 0.8 * n)
        assert similar.spare(n, 0.8) >= n - least
    assert [similar.spare(n, 0.8) for n in (1, 4, 5, 10)] == [0, 0, 1, 2]
