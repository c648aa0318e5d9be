import base64
import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cpgdomains.llm.bpe import codec, decode_documents, encode_documents, stitch

from .data import ODD, docs

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def library(pattern=PATTERN):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def test_against_the_library(spark):
    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [(50, "x" * 3000 + " tail " + " " * 500), (51, "a b\n" * 400)]
    enc = library()
    for chunk, overlap in ((1 << 15, 512), (64, 16)):
        encoded = encode_documents(docs(spark, rows), RANKS, PATTERN, chunk, overlap)
        found = {r.doc_id: r for r in decode_documents(encoded, RANKS, PATTERN).collect()}
        assert len(found) == len(rows)
        for i, t in rows:
            ids, r = enc.encode_ordinary(t or ""), found[i]
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert bytes(r.decoded).decode() == (t or "") and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_repeated_null_ids_and_empty_table(spark):
    found = decode_documents(encode_documents(docs(spark, [(None, "ab " * 60), (None, "c"), (1, "d"), (1, "d")]), RANKS, PATTERN, 32, 8), RANKS, PATTERN)
    assert sorted(bytes(r.decoded) for r in found.collect()) == sorted([b"ab " * 60, b"c", b"d", b"d"])
    assert encode_documents(docs(spark, []), RANKS, PATTERN).count() == 0


@given(st.text(st.sampled_from(list("ab é\n'.st12 ")), min_size=20, max_size=120), st.integers(4, 20), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_stitched_bounds_are_those_of_the_whole(text, step, overlap):
    if len(text) <= step + overlap:
        return
    c = codec(RANKS, PATTERN)
    n = -(-(len(text) - overlap) // step)
    parts = [text[k * step : k * step + step + overlap] for k in range(n)]
    whole, ends = stitch(parts, [c.bounds(p) for p in parts], step, c.bounds)
    assert whole == text and ends.tolist() == c.bounds(text).tolist()


def test_other_patterns_are_not_cut(spark):
    """Here a newline and the spaces after it are told apart by what follows them, however far off."""
    pattern = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s*[\r\n]+|\s+(?!\S)|\s+"
    rows = [(1, "ab " * 40 + "\n" + " " * 300 + "x\n\n y"), (2, "\n" * 50 + " " * 90)]
    encoded = encode_documents(docs(spark, rows), RANKS, pattern, 64, 16)
    found = {r.doc_id: r.ids_sha256 for r in decode_documents(encoded, RANKS, pattern).collect()}
    enc = library(pattern)
    assert found == {i: hashlib.sha256(",".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest() for i, t in rows}
