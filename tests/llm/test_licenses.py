import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from cpgdomains.llm.licenses import BASE, NOTICES, Scanner, normal, scan_licenses

from .data import ODD, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = ["MIT License mit-license; CC BY cc by cc", "The GNU General  Public\nLicense and Apache License.", "emit license", "gnu genral publc license", "permission is hereby grantd, free of charge", "", None, "été CC BY"]


def test_base_places_and_fuzzy_labels(spark):
    rows = list(enumerate(TEXTS)) + [(100 + k, t) for k, (_, t) in enumerate(ODD)]
    found = {r.doc_id: r for r in scan_licenses(docs(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert found[3].labels == "gpl" and found[3].base_labels == "" and 0.8 < found[3].score < 1
    assert found[3].spans[0].first_word == 0 and found[3].spans[0].n_words == 4 and found[3].spans[0].errors == 2
    assert found[4].labels == "mit" and found[5].labels == "" and found[5].score == 0


def test_null_ids_and_empty_table(spark):
    assert scan_licenses(docs(spark, [(None, "cc by"), (None, "cc by"), (1, "cc by"), (1, "cc by")])).where("n_base = 1").count() == 4
    assert scan_licenses(docs(spark, [])).count() == 0


@given(st.sampled_from(NOTICES), st.data())
@settings(max_examples=150, deadline=None)
def test_seeds_lose_no_match(notice, data):
    """Whatever has at most the allowed edits, on word boundaries, is found."""
    text, label, errors = notice
    made = list(text)
    for _ in range(data.draw(st.integers(0, errors))):
        at, kind = data.draw(st.integers(1, len(made) - 2)), data.draw(st.sampled_from("ids"))
        letter = data.draw(st.sampled_from("xqz"))
        if kind == "i":
            made.insert(at, letter)
        elif kind == "s":
            made[at] = letter
        elif len(made) > 3:
            made.pop(at)
    scanner = Scanner()
    plain, _ = normal(f"before {''.join(made)} after".encode())
    i = next(k for k, n in enumerate(NOTICES) if n is notice)
    direct = list(scanner.matchers[i].finditer(plain))
    assert bool(direct) == any(k == i for k, *_ in scanner.fuzzy(plain))


def test_every_place_of_a_notice_is_reported():
    plain, _ = normal(b"mit licens mit license, MIT LICENCE and mit licence")
    scanner = Scanner([("mit license", "mit", 1)])
    assert [(e, plain[s:t]) for _, e, s, t in scanner.fuzzy(plain)] == [(1, b"mit licens"), (0, b"mit license"), (1, b"mit licence"), (1, b"mit licence")]


@given(st.lists(st.sampled_from(["mit license", "mit licens", "mt license", "mit", "license", "x", "mit lic ense"]), max_size=12))
@settings(max_examples=150, deadline=None)
def test_places_by_brute_force(parts):
    """All word spans within one edit; greedily the best ones that don't overlap."""
    plain, _ = normal(" ".join(parts).encode())
    words = plain.split()
    ends = [m.end() for m in re.finditer(rb"\S+", plain)]
    starts = [m.start() for m in re.finditer(rb"\S+", plain)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    hits = []
    for i in range(len(words)):
        for j in range(i, min(len(words), i + 4)):
            if (e := edits(plain[starts[i] : ends[j]], b"mit license")) <= 1:
                hits.append((e, starts[i], ends[j]))
    taken = []
    for e, s, t in sorted(hits):
        if all(t <= a or b <= s for _, a, b in taken):
            taken.append((e, s, t))
    found = Scanner([("mit license", "mit", 1)]).fuzzy(plain)
    assert sorted((s, t, e) for _, e, s, t in found) == sorted((s, t, e) for e, s, t in taken)


def test_a_megabyte_of_notices_takes_seconds():
    scanner = Scanner()
    for part in (b"gnu general public licens ", b"mit license ", b"gnu gnu general general public "):
        began = time.process_time()
        row = scanner.scan(part * (1_000_000 // len(part)))
        assert time.process_time() - began < 40 and row[0] > 100_000 // 2
