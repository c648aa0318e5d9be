import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cpgdomains.llm import substring_dedup as module
from cpgdomains.llm.common import range_groups
from cpgdomains.llm.substring_dedup import Windows, covered, pack, substring_dedup, unpack, window_hashes, word_hashes

from .data import ODD, PASSAGE, docs


def brute(rows, size=13):
    key = lambda i: -(2**63) if i is None else i
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - size + 1):
            at = tuple(w[k : k + size])
            first[at] = min(first.get(at, key(i)), key(i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < key(i):
                gone[k : k + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    words = np.random.default_rng(5).integers(0, 3, (60, 80))
    rows = ODD + [(100 + i, " ".join(f"v{x}" for x in w[: 20 + i])) for i, w in enumerate(words)]
    for group, bucket, size in ((200, 100, 13), (1 << 20, 1 << 20, 13), (500, 1000, 5)):
        found = substring_dedup(docs(spark, rows), size=size, group_bytes=group, bucket_bytes=bucket).drop("spans").collect()
        assert sorted((tuple(r) for r in found), key=str) == brute(rows, size)


def test_spans_texts_and_carried_columns(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(15))
    rows = [(1, a), (2, f"x y {a} z {b}"), (3, f"{b}\n {a}"), (4, "kept  as it\nis")]
    found = {r.doc_id: r for r in substring_dedup(docs(spark, rows), texts=True, carry=("lang", "g", "h")).collect()}
    assert found[2].spans == [2, 22] and found[2].kept_text == f"x y z {b}"
    assert found[3].spans == [0, 35] and found[3].kept_text == "" and found[3].n_removed == 35
    assert found[4].kept_text == "kept  as it\nis" and (found[4].carried.lang, found[4].carried.g, found[4].carried.h) == ("en", 2, 1)
    assert substring_dedup(docs(spark, [(1, None)]), texts=True).first().kept_text is None


@pytest.mark.parametrize("bits", [0, 3, 10])
def test_agreeing_hashes_remove_nothing(spark, bits):
    """With so few bits nearly all windows agree in their hash; the words themselves decide."""
    words = np.random.default_rng(6).integers(0, 3, (40, 60))
    rows = ODD + [(100 + i, " ".join(f"v{x}" for x in w[: 20 + i])) for i, w in enumerate(words)]
    for group in (300, 1 << 20):
        found = substring_dedup(docs(spark, rows), size=5, group_bytes=group, bits=bits).drop("spans").collect()
        assert sorted((tuple(r) for r in found), key=str) == brute(rows, 5)


def test_rows_of_one_id_are_dealt_to_several_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [(7 if i % 3 else None, f"t{i % 5} {PASSAGE} e{rng.integers(9)}") for i in range(300)] + [(k, f"x {PASSAGE} y{k}") for k in (1, 9)]
    table = docs(spark, rows)
    groups = range_groups(table, 2000, F.xxhash64("text", F.spark_partition_id()))
    sizes = [r[1] for r in table.groupBy(groups.group).count().collect()]
    assert max(sizes) < 60 and len(set(groups.ranks.tolist())) < len(groups.ranks)
    found = substring_dedup(table, group_bytes=2000).drop("spans").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_ranges_follow_bytes(spark):
    rng = np.random.default_rng(2)
    ids = np.unique(np.concatenate([rng.integers(-(2**62), 2**62, 40), rng.integers(0, 200, 300), [2**63 - 1, -(2**63) + 1]])).tolist()
    rows = [(i, "z" * int(rng.integers(0, 300))) for i in ids] + [(None, "q"), (5, "w" * 5000)]
    table = docs(spark, rows)
    groups = range_groups(table, 1500)
    by = {}
    for i, t, g in table.select("doc_id", "text", groups.group).collect():
        by.setdefault(g, []).append((-(2**63) if i is None else i, len(t) + 64))
    assert sorted(i for g in by for i, _ in by[g]) == sorted(-(2**63) if i is None else i for i, _ in rows)
    assert all(sum(n for _, n in x) <= 1500 or len({i for i, _ in x}) == 1 for x in by.values())
    spans = sorted((min(x)[0], max(x)[0], g) for g, x in by.items())
    assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(spans, spans[1:], strict=False))


def test_a_long_document_is_hashed_in_parts(monkeypatch):
    text = (" ".join(f"w{i % 50}" for i in range(3000))).encode()
    whole = Windows.of(pa.chunked_array([pa.array([b"a b", text, b""])]), 13, 64)
    monkeypatch.setattr(module, "_CHUNK", 700)
    parts = Windows.of(pa.chunked_array([pa.array([b"a b", text, b""])]), 13, 64)
    assert (whole.hash == parts.hash).all() and (whole.place == parts.place).all() and (whole.doc == parts.doc).all() and (whole.counts == parts.counts).all()


def test_empty_table(spark):
    assert substring_dedup(docs(spark, [])).count() == 0


@given(st.lists(st.lists(st.sampled_from(["a", "bb", "ccc", "é"]), max_size=12), max_size=6), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_window_hashes_tell_windows_apart(texts, size):
    raw = [(" ".join(t) + " ").encode() if t else b"" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    words, counts = word_hashes(data, offsets)
    assert counts.tolist() == [len(t) for t in texts]
    hashes, at = window_hashes(words, counts, size)
    wanted = [tuple(t[i : i + size]) for t in texts for i in range(len(t) - size + 1)]
    assert len(wanted) == len(hashes)
    assert len(set(wanted)) == len(set(hashes.tolist())) == len(set(zip(wanted, hashes.tolist(), strict=True)))


@given(st.sets(st.integers(0, 2**64 - 1), max_size=50))
def test_pack_round_trip(values):
    a = np.array(sorted(values), dtype=np.uint64)
    assert (unpack(pack(a)) == a).all()


def test_covered():
    assert covered(np.array([1, 2]), 6, 3).tolist() == [False, True, True, True, True, False]
