"""License scans: exact phrase places, and fuzzy search for short notices.

Texts are reduced to lower-case words joined by one space. A notice that may have k errors is split into k + 1 seeds:
whatever matches it with at most k errors holds one seed unchanged. Seeds are found by exact search. Around each hit,
in a window little longer than the notice, the regex library matches the notice with its bounded number of errors, on word
boundaries; of matches that overlap the best is a place. So the work follows the number of hits, also on texts that repeat a notice.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Short notices searched with errors: text, label, most errors (insertions, deletions, substitutions of a byte).
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("apache license version 2 0", "apache-2.0", 2),
    ("licensed under the apache license", "apache", 3),
    ("mit license", "mit", 1),
    ("permission is hereby granted free of charge", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc-by", 3),
    ("all rights reserved", "all-rights-reserved", 2),
    ("gnu affero general public license", "agpl", 3),
    ("gnu free documentation license", "gfdl", 3),
    ("licensed under the mit license", "mit", 3),
    ("permission to use copy modify and or distribute this software", "isc", 5),
    ("eclipse public license", "epl", 2),
    ("boost software license", "bsl", 2),
    ("common development and distribution license", "cddl", 4),
    ("free and unencumbered software released into the public domain", "unlicense", 5),
    ("dedicated to the public domain", "public-domain", 3),
)

#: Bytes that words hold: digits, lower-case letters and all of non-ASCII; A-Z turn lower-case.
_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


@dataclass(frozen=True)
class Notice:
    text: bytes
    label: str
    errors: int

    def __post_init__(self) -> None:
        if len(self.text) <= 4 * self.errors + 2:  # a window must not hold two places
            raise ValueError(f"{self.text!r} is too short for {self.errors} errors")

    def seeds(self) -> list[tuple[int, bytes]]:
        """(offset, bytes) of errors + 1 pieces."""
        n, k = len(self.text), self.errors + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(s, self.text[s:e]) for s, e in zip(cuts, cuts[1:])]

    def matcher(self):
        return regex.compile(rb"(?<=\x20)(?:" + regex.escape(self.text) + rb"){e<=%d}(?=\x20)" % self.errors, regex.BESTMATCH)


def normal(text: bytes) -> tuple[bytes, int]:
    """(words joined and surrounded by single spaces, number of words)."""
    words = text.translate(_WORD).split()
    return b" " + b" ".join(words) + b" ", len(words)


def hits_of(plain: bytes, wanted: bytes) -> list[int]:
    """Every place of ``wanted``, overlapping ones too."""
    out, at = [], -1
    while (at := plain.find(wanted, at + 1)) >= 0:
        out.append(at)
    return out


def places(plain: bytes, phrase: bytes) -> list[int]:
    """Where the words of ``phrase`` stand consecutively: byte offsets of the space before each."""
    return hits_of(plain, b" " + phrase + b" ")


def apart(matches: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (errors, start, end), those of fewest errors, then the first, that don't overlap one taken before."""
    taken: list[tuple[int, int, int]] = []  # (start, end, errors) in order
    for errors, start, end in sorted(matches):
        k = bisect_left(taken, (start, end, errors))
        if (not k or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
            insort(taken, (start, end, errors))
    return [(errors, start, end) for start, end, errors in taken]


class Scanner:
    def __init__(self, notices=NOTICES) -> None:
        self.notices = [Notice(t.encode(), label, k) for t, label, k in notices]
        self.matchers = [n.matcher() for n in self.notices]
        seeds: dict[bytes, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            for offset, seed in n.seeds():
                seeds.setdefault(seed, []).append((i, offset))
        self.seeds = seeds

    def fuzzy(self, plain: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, errors, start, end) of every place of a notice, spans in bytes of ``plain``; places of one notice don't overlap."""
        begins: dict[int, set[int]] = {}
        for seed, targets in self.seeds.items():
            if hits := hits_of(plain, seed):
                for i, offset in targets:
                    begins.setdefault(i, set()).update(h - offset for h in hits)
        out = []
        for i, found in begins.items():
            k, n = self.notices[i].errors, len(self.notices[i].text)
            search = self.matchers[i].search
            # a match that holds a seed unchanged lies at most k bytes off it on either side
            matches = (search(plain, max(0, at - k - 1), at + n + k + 1) for at in found)
            out += [(i, *x) for x in apart({(sum(m.fuzzy_counts), m.start(), m.end()) for m in matches if m})]
        return out

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of fuzzy matches."""
        plain, n_words = normal(text)
        base, starts, n_base = set(), [], 0
        for phrase, label in BASE:
            if at := places(plain, phrase.encode()):
                base.add(label)
                n_base += len(at)
                starts += [at[0], at[-1]]
        found = self.fuzzy(plain)
        spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x20) if found or starts else np.zeros(0, np.int64)
        word = lambda at: int(np.searchsorted(spaces, at, side="right")) - 1
        labels = base | {self.notices[i].label for i, *_ in found}
        score = max([1.0] * bool(base) + [1 - e / len(self.notices[i].text) for i, e, *_ in found], default=0.0)
        spans = [{"label": self.notices[i].label, "first_word": word(s - 1), "n_words": plain.count(b" ", s, e) + 1, "errors": e0} for i, e0, s, e in sorted(found, key=lambda x: (x[2], x[3], x[0]))]
        return n_words, n_base, word(min(starts)) if starts else None, word(max(starts)) if starts else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


_KINDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int32())]))}


def _scan(notices):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            rows = [scanner.scan(t) for t in batch["text"].to_pylist()]
            cols = zip(*rows, strict=True) if rows else [[]] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(cols, _KINDS.values(), strict=True))], names=["doc_id", *_KINDS])

    return f


def scan_licenses(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``score``: 1 for an exact base phrase, else 1 - errors / length of the best fuzzy match, 0 without any. Null or
    empty text: no words, empty labels, null places. Very long texts, also of nothing but notices, take time in proportion to
    their length. Rows with equal or null doc_id are scanned apart. Empty table: no rows. Other columns are not read. No shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(_scan(notices), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long,errors:int>>")
