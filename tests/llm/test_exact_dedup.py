import hashlib

import numpy as np
import pyarrow as pa
import pytest

from cpgdomains.llm.common import shared_dir
from cpgdomains.llm.exact_dedup import _fold, build_index, exact_dedup, lookup, split

from .data import ODD, docs


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    key = lambda i: -(2**63) if i is None else i
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max(g, key=key)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    for capacity in (1, 200, 1 << 24):  # 1: every bucket splits until it holds one hash
        found = exact_dedup(docs(spark, ODD), capacity=capacity).collect()
        assert sorted((tuple(r) for r in found), key=str) == brute(ODD)


def test_empty_table(spark):
    assert exact_dedup(docs(spark, [])).count() == 0


def test_directory_doubles_and_chains(spark):
    rows = [(i, f"text number {i}") for i in range(300)] + [(1000 + i, "copy") for i in range(50)]
    index = build_index(docs(spark, rows), capacity=2000)
    buckets = sorted(index.directory(spark).collect(), key=lambda b: b.first)
    assert index.depth >= 2 and index.buckets == len(buckets) > 4 and index.depth == max(b.depth for b in buckets)
    slots = []  # the whole directory, each bucket's slots in turn
    for b in buckets:
        assert (b.first + 2**63) >> (64 - index.depth) == len(slots)
        slots += [b.bucket] * 2 ** (index.depth - b.depth)
    assert len(slots) == 2**index.depth
    pages = index.pages(spark).collect()
    assert len(pages) == 301 and sum(p.group_size for p in pages) == 350
    assert all(slots[(p.h % 2**64) >> (64 - index.depth)] == p.bucket for p in pages)
    assert all(a.owner <= b.owner for a, b in zip(buckets, buckets[1:], strict=False))


def test_lookup_of_new_texts(spark):
    index = build_index(docs(spark, [(1, "a"), (2, "a")]))
    found = {r.doc_id: (r.keep_id, r.group_size) for r in lookup(docs(spark, [(10, "a"), (11, "b")]), index).collect()}
    assert found == {10: (2, 2), 11: (None, None)}


def test_a_text_over_the_capacity_fills_a_bucket_alone(spark):
    """17 MB among 1000 small ones, by the production capacity; the number of jobs doesn't follow the buckets."""
    long = "word " * (17 << 18)
    rows = [(i, f"small {i}") for i in range(1000)] + [(2000, long), (2001, long)]
    table = docs(spark, rows)
    tracker = spark.sparkContext.statusTracker()

    def jobs(capacity):
        spark.sparkContext.setJobGroup(f"index-{capacity}", "")
        index = build_index(table, capacity=capacity)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return index, len(tracker.getJobIdsForGroup(f"index-{capacity}"))

    (whole, few), (fine, many) = jobs(16 << 20), jobs(100)
    assert whole.buckets < 100 and whole.depth < 64 and fine.buckets > 1000
    assert many <= few + 2
    sizes = [b.bytes for b in whole.directory(spark).collect()]
    assert sum(s > 16 << 20 for s in sizes) == 1
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(table).collect()}
    assert found[2000] == found[2001] == (2001, 2) and found[5] == (5, 1)


@pytest.mark.parametrize("capacity", [0, 5, 100])
def test_split_stops_at_single_hashes(capacity):
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 40, dtype=np.uint64))
    keys = np.unique(np.concatenate([keys, keys[:1] ^ np.uint64(1)]))
    sizes = np.full(len(keys), 10)
    sizes[3] = 10_000
    out = split(keys, sizes, capacity)
    assert sum(s for *_, s in out) == sizes.sum()
    at = 0
    for p, d, s in out:  # end to end over the whole key space
        assert p << (64 - d) == at
        at += 1 << (64 - d)
        inside = ((keys >> np.uint64(64 - d)) == np.uint64(p)).sum() if d else len(keys)
        assert s <= capacity or inside == 1
    assert at == 1 << 64


def test_rows_of_one_id_are_told_apart_by_their_number(spark):
    rows = [(9, "x"), (9, "x"), (None, "n"), (None, "n"), (5, "x"), (5, "own")]
    table = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, nr long")
    assert {r.nr for r in exact_dedup(table, row="nr").where("kept").collect()} == {1, 3, 5}


def test_a_hot_text_leaves_a_task_once():
    rows = [(i, i, 7, b"hot" * 100) if i % 2 else (i, i, i, b"%0300d" % i) for i in range(400)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("doc_id", "row", "k", "text"), r, strict=True)) for r in rows[i : i + 50]]) for i in range(0, 400, 50)]
    out = [r for b in _fold(np.array([-(2**63)]), np.array([0], dtype=np.int32), most=3000)(iter(batches)) for r in b.to_pylist()]
    assert sum(r["n"] for r in out) == 400 and sum(r["text"].startswith(b"hot") for r in out) == 1


def test_a_shared_folder_is_needed_on_a_cluster():
    class Session:
        class sparkContext:
            master = "yarn"

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session, "x")
