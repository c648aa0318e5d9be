from collections import Counter

import numpy as np
import pytest
import xxhash

from cpgdomains.llm import simhash as s

from .data import ODD, docs


def plain(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Forest:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


@pytest.mark.parametrize("seed", range(6))
def test_least_forest_is_kruskals(seed):
    rng = np.random.default_rng(seed)
    n, m = 40, int(rng.integers(0, 300))
    links = rng.integers(0, n, (2, m))
    forest, wanted = Forest(n), []
    for k in range(m):
        i, j = links[:, k].tolist()
        if forest.root(i) != forest.root(j):
            forest.join(i, j)
            wanted.append(k)
    assert s.least_forest(links, n).tolist() == wanted


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"word{i}" for i in range(400)]
    rows = list(ODD)
    for k in range(60):
        words = list(base[(k % 3) * 100 : (k % 3) * 100 + 300])
        for _ in range(k // 20):
            words[rng.integers(len(words))] = "changed"
        rows.append((100 + k, " ".join(words)))
    found = s.simhash_dedup(docs(spark, rows), leaf=4).collect()
    fps = [plain(t) for _, t in rows]
    forest = Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                forest.join(i, j)
    key = lambda i: -(2**63) if i is None else i
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(forest.root(i), []).append(rows[i][0])
    wanted = sorted(((rows[i][0], f"{fps[i]:016x}", min(groups[forest.root(i)], key=key)) for i in range(len(rows))), key=str)
    assert sorted((tuple(r) for r in found), key=str) == wanted


def test_empty_table_and_one_class(spark):
    assert s.simhash_dedup(docs(spark, [])).count() == 0
    assert {r.component_id for r in s.simhash_dedup(docs(spark, [(4, "a"), (2, "a")])).collect()} == {2}


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_join_finds_each_pair_once(budget):
    rng = np.random.default_rng(budget)
    noise = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(400)], dtype=np.uint64)
    v = np.unique(np.concatenate([noise ^ np.uint64(0xABCDEF), rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    close = np.bitwise_count(v[:, None] ^ v[None, :]) <= budget
    wanted = {(int(i), int(j)) for i, j in zip(*np.nonzero(close), strict=True) if i < j}
    got = [(int(i), int(j)) for a, b in s.trie_join(v, (0, len(v)), s.schedule(budget), most=64) for i, j in zip(a, b, strict=True)]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    found = {r.node: r.component for r in s.components(links).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_partners_cover_all_close_prefixes():
    leaves = s.split_top({p: 10 if p % 3 else 1 for p in range(64)}, 6, 15)
    starts, depths = np.array([p << (64 - d) for p, d in leaves], dtype=np.uint64), np.array([d for _, d in leaves])
    for i, (p, d) in enumerate(leaves):
        found = s.partners(i, starts, depths, s.schedule(2))
        assert len(found) == len(set(found))
        for j, (q, e) in enumerate(leaves):
            m = min(d, e)
            assert (((p >> (d - m)) ^ (q >> (e - m))).bit_count() <= 2) == (j in found)


@pytest.mark.parametrize("together", [1, 50])
def test_pieces_of_a_leafs_partners_find_the_same_links(spark, monkeypatch, together):
    rng = np.random.default_rng(9)
    base = [f"word{i}" for i in range(200)]
    rows = []
    for k in range(120):
        words = list(base[(k % 4) * 40 :])
        words[rng.integers(len(words))] = "changed"
        rows.append((k, " ".join(words)))
    wanted = {r.doc_id: r.component_id for r in s.simhash_dedup(docs(spark, rows), leaf=4).collect()}
    monkeypatch.setattr(s, "TOGETHER", together)
    assert {r.doc_id: r.component_id for r in s.simhash_dedup(docs(spark, rows), leaf=4).collect()} == wanted


def test_home_pairs_come_with_one_piece_only():
    v = np.arange(12, dtype=np.uint64) << np.uint64(60)
    both, rest = (sum(len(a) for a, _ in s.trie_join(v, (0, 4), s.schedule(4), within=w)) for w in (True, False))
    assert (both, rest) == (6 + 32, 32)


def test_verified_links_find_near_copies_only(spark):
    rng = np.random.default_rng(8)
    rows, k = [], 0
    for g in range(25):
        base = [f"v{rng.integers(10_000)}" for _ in range(300)]
        for changes in (0, 3, 5, 30):  # 5 changes leave a similarity over 0.8, 30 one under 0.5
            words = list(base)
            for at in rng.choice(300, changes, replace=False):
                words[at] = f"n{rng.integers(10**9)}"
            rows.append((k, " ".join(words)))
            k += 1
    found = {r.doc_id: r.component_id for r in s.simhash_dedup(docs(spark, rows), similar=0.8, leaf=8).collect()}
    near = [found[i] == i - i % 4 for i in range(len(rows)) if i % 4 in (1, 2)]
    assert np.mean(near) > 0.9
    assert all(found[i] == i for i in range(len(rows)) if i % 4 in (0, 3))


def test_forest_keeps_the_closest_links():
    v = np.array([0b0, 0b1, 0b11, 0b1111], dtype=np.uint64)
    pairs = [(np.array([0, 0, 1]), np.array([3, 2, 3])), (np.array([0, 1, 2]), np.array([1, 2, 3]))]
    a, b = s.spanning_pairs(v, iter(pairs))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(0, 1), (1, 2), (2, 3)}


def test_schedule():
    assert s.schedule(2) == [2] * 65
    wide = s.schedule(10, 2)
    assert wide[0] == wide[17] == 2 and wide[18] == 3 and wide[64] == 10 and all(x <= y for x, y in zip(wide, wide[1:], strict=False))


def similarities(texts, size=5):
    """Jaccard similarity of every two texts."""
    sets = [{" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (t.split() for t in texts)]
    shared = [x for x, n in Counter(x for s in sets for x in s).items() if n > 1]
    at = {x: k for k, x in enumerate(shared)}
    held = np.zeros((len(texts), len(shared)), dtype=np.float32)
    for i, x in enumerate(sets):
        held[i, [at[y] for y in x if y in at]] = 1
    both, size_of = held @ held.T, np.array([len(x) for x in sets])
    return both / (size_of[:, None] + size_of[None, :] - both)


def test_links_that_fail_the_check_hide_none_that_pass(spark):
    """1000 edited copies: a nearer fingerprint's text may lie under 0.8 where a farther one's does not."""
    rng = np.random.default_rng(11)
    base = [f"v{rng.integers(10_000)}" for _ in range(300)]
    texts = []
    for _ in range(1000):
        words = list(texts[rng.integers(len(texts))].split()) if texts and rng.random() < 0.5 else list(base)
        for at in rng.choice(300, rng.integers(4, 12), replace=False):
            words[at] = f"n{rng.integers(10**9)}"
        texts.append(" ".join(words))
    values = np.array([s.fingerprint(t.encode()) for t in texts], dtype=np.uint64)
    assert len(np.unique(values)) == len(values)
    bits = np.bitwise_count(values[:, None] ^ values[None, :])
    linked = similarities(texts) >= 0.8
    ones = [int((values >> np.uint64(k) & np.uint64(1)).sum()) for k in range(64)]
    order = sorted(range(64), key=lambda k: (abs(2 * ones[k] - len(values)), k))
    forest = Forest(len(texts))
    for turn in range(4):
        of = s.permute(values, s.in_turn(order, turn))
        by = np.argsort(of)
        for a, b in s.trie_join(of[by], (0, len(of)), s.schedule(10, 2)):
            for i, j in zip(by[a].tolist(), by[b].tolist(), strict=True):
                if linked[i, j]:
                    forest.join(i, j)
    found = {r.doc_id: r.component_id for r in s.simhash_dedup(docs(spark, list(enumerate(texts))), similar=0.8).collect()}
    assert all(found[i] == found[forest.root(i)] for i in found)
    assert len({forest.root(i) for i in found}) < len(texts)
    for i in found:  # a group's checks may reach a pair that no order finds, but never one that fails
        others = [j for j in found if j != i and found[j] == found[i]]
        assert not others or (linked[i, others] & (bits[i, others] <= 10)).any()


def test_alike_forest_joins_what_all_passing_pairs_join():
    rng = np.random.default_rng(5)
    fps = np.array([sum(1 << int(b) for b in rng.choice(12, 4, replace=False)) for _ in range(60)], dtype=np.uint64)
    sets = [np.unique(rng.integers(0, 14, 12)).astype("<u8") for _ in fps]
    ratio = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    wanted, got = Forest(60), Forest(60)
    for i in range(60):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and ratio(i, j) >= 0.8:
                wanted.join(i, j)
    for i, j in s.alike_forest(fps, np.arange(60), sets, 4, 0.8):
        assert ratio(i, j) >= 0.8
        got.join(i, j)
    assert [wanted.root(i) for i in range(60)] == [got.root(i) for i in range(60)]


def test_two_bits_alone_make_no_near_copy(spark):
    rng = np.random.default_rng(2)
    phrase = " ".join(f"p{i}" for i in range(30))
    while True:  # what repeats rules the fingerprint, but counts once in the similarity
        a, b = (" ".join([phrase] * 20 + [f"t{rng.integers(10**9)}" for _ in range(40)]) for _ in range(2))
        if 1 <= (plain(a) ^ plain(b)).bit_count() <= 2:
            break
    assert similarities([a, b])[0, 1] < 0.8
    table = docs(spark, [(1, a), (2, b), (3, a + " end")])
    assert {r.doc_id: r.component_id for r in s.simhash_dedup(table, similar=0.8).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.component_id for r in s.simhash_dedup(table).collect()}[2] == 1


def test_recall_over_thousands_of_texts(spark):
    """Near copies of all similarities from 0.8 on, among unrelated texts: the usual setting finds 0.95 of the documents, the exact one no fewer."""
    rng = np.random.default_rng(21)
    texts = []
    for g in range(700):
        n = int(rng.integers(60, 400))
        base = [f"v{rng.integers(30_000)}" for _ in range(n)]
        for copy in range(4):
            words = list(base)
            for at in rng.choice(n, min(n, int(rng.integers(0, max(2, n // 40))) if copy else 0), replace=False):
                words[at] = f"n{rng.integers(10**9)}"
            texts.append(" ".join(words))
    linked = similarities(texts) >= 0.8
    forest = Forest(len(texts))
    for i, j in zip(*np.nonzero(linked), strict=True):
        forest.join(int(i), int(j))
    wanted = {i for i in range(len(texts)) if forest.root(i) != i}
    found = {r.doc_id: r.component_id for r in s.simhash_dedup(docs(spark, list(enumerate(texts))), similar=0.8).collect()}
    gone = {i for i, c in found.items() if c != i}
    assert len(wanted) > 1000 and len(gone & wanted) >= 0.95 * len(wanted)
    assert not gone - wanted


def test_rows_of_one_id_are_told_apart_by_their_number(spark):
    rows = [(5, "a b c"), (5, "a b c"), (7, "a b c"), (5, "unique text here that differs"), (None, "n n"), (None, "n n")]
    table = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, nr long")
    for similar in (None, 0.8):
        assert {r.nr for r in s.simhash_dedup(table, similar=similar, row="nr").where("first").collect()} == {0, 3, 4}


def test_exact_setting_finds_every_pair(spark):
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 4), replace=False):
            words[at] = f"n{rng.integers(10**9)}"
        texts.append(" ".join(words))
    values = np.array([s.fingerprint(t.encode()) for t in texts], dtype=np.uint64)
    near = (np.bitwise_count(values[:, None] ^ values[None, :]) <= 12) & (similarities(texts) >= 0.8) | (values[:, None] == values[None, :])
    forest = Forest(len(texts))
    for i, j in zip(*np.nonzero(near), strict=True):
        forest.join(int(i), int(j))
    found = {r.doc_id: r.component_id for r in s.simhash_dedup(docs(spark, list(enumerate(texts))), similar=0.8, reach=12, exact=True, leaf=8).collect()}
    assert found == {i: forest.root(i) for i in range(len(texts))}
