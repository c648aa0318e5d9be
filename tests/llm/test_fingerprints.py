import hashlib
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cpgdomains.llm.fingerprints import Sketches, compare, differences, digests, edited, fingerprint_versions, fingerprints, likenesses

from .data import ODD, docs


def dice(a, b):
    x, y = Counter(digests(a).tolist()), Counter(digests(b).tolist())
    n = sum(x.values()) + sum(y.values())
    return 1 - sum(((x - y) + (y - x)).values()) / n if n else 1.0


def test_against_sets(spark):
    rows = ODD + [(50 + i, "\n".join(f"line {j} of {i % 4}" for j in range(i))) for i in range(40)]
    rows += [(70, f"one of many rows {k % 40}\nthat share an id") for k in range(120)] + [(None, f"no id\n{k}") for k in range(30)]
    for group in (400, 1 << 20):
        found = fingerprint_versions(docs(spark, rows), group).collect()
        order = sorted((-1 if i is None else i, xxhash.xxh64_intdigest((t or "").encode(), 42), t or "") for i, t in rows)
        wanted = []
        for k, (i, _, t) in enumerate(order):
            n = order[(k + 1) % len(order)][2]
            e = edited(t, n)
            wanted.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(dice(t, e), 9), round(dice(t, n), 9)))
        got = [(-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found]
        assert sorted(got) == sorted(wanted)
        texts = {}
        for r in found:
            key = (r.doc_id, r.n_chars)
            if r.doc_id not in (None, 70):
                assert texts.setdefault(key, r.fingerprint) == r.fingerprint
        assert len({r.fingerprint for r in found if r.doc_id in (3, 5, 7)}) == 1


def test_repeats_of_short_paragraphs_have_their_own_digests():
    text = "\n".join(["a", "b", "ab", "."] * 400)
    assert len(digests(text)) == 1600
    assert likenesses([digests(text)], [digests(text + "\na")]) == [1 - 1 / 3201]


def test_one_document_and_none(spark):
    row = fingerprint_versions(docs(spark, [(1, "abcd")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1
    assert fingerprint_versions(docs(spark, [])).count() == 0


def test_edit_takes_code_points():
    assert edited("äöüßx", "1234") == "äöü12" and edited("abcd", "z") == "abz" and edited("", "x") == "" and edited("a", "x") == "a"


@given(st.sets(st.integers(0, 2**64 - 1), max_size=40), st.sets(st.integers(0, 2**64 - 1), max_size=40), st.sets(st.integers(0, 2**64 - 1), max_size=200))
@settings(max_examples=80, deadline=None)
def test_peeling_recovers_both_sides(a, b, common):
    left, right = (np.array(sorted(x | common), dtype=np.uint64) for x in (a, b))
    (ours, theirs), = differences([left], [right])
    assert set(ours.tolist()) == (a | common) - (b | common) and set(theirs.tolist()) == (b | common) - (a | common)


def test_small_sketch_fails_and_grows():
    x = np.arange(1, 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    small = Sketches.of(x, np.zeros(100, int), np.array([4]))
    assert not small.peel()[3][0]
    assert likenesses([x], [x[:50]]) == [1 - 50 / 150]


@given(st.integers(0, 200), st.integers(0, 60), st.integers(0, 60))
@settings(max_examples=80, deadline=None)
def test_stored_fingerprints_compare(common, a, b):
    x = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    left, right = np.sort(x[: common + a]), np.sort(np.concatenate([x[:common], x[300 : 300 + b]]))
    one, two = fingerprints([left, right])
    found = compare(one, two)
    if a + b <= 4:
        assert found is not None
    if found is not None:
        assert found == likenesses([left], [right])[0]
    if a + b > 48:
        assert found is None
