import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cpgdomains.llm.token_files import TokenFile, decode_blocks, encode_blocks, read_token_files, write_file, write_token_files
from cpgdomains.llm.tokens import cut, encoder

from .data import ODD, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([1, 8, 64, 256]), st.sampled_from([1, 50, 95, 100]))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(ids, block, percentile):
    x = np.array(ids, dtype=np.uint32)
    blocks, starts = encode_blocks(x, block, percentile)
    assert (decode_blocks(memoryview(blocks), starts, len(x), block) == x).all() and len(starts) == -(-len(x) // block) + 1


def test_outliers_are_exceptions():
    x = np.full(256, 7, dtype=np.uint32)
    x[100] = 2**31
    blocks, _ = encode_blocks(x, 256)
    assert len(blocks) == 7 + 2 + 4


def test_index_reads_any_run():
    streams = [np.arange(n, dtype=np.uint32) * 3 for n in (5, 0, 3000, 1)]
    file = TokenFile(write_file(np.array([1, 2, 3, 4]), streams))
    whole = np.concatenate(streams)
    assert (file.ids(1000, 2500) == whole[1000:2500]).all() and (file.ids(0, 3006) == whole).all() and file.lengths.tolist() == [5, 0, 3000, 1]


def test_files_against_the_library(spark):
    for group in (300, 1 << 20):
        found = read_token_files(spark, write_token_files(docs(spark, ODD), PATH, group_bytes=group)).orderBy("start").collect()
        t = Tokenizer.from_file(PATH)
        rows = sorted(((-1 if i is None else i, x or "") for i, x in ODD))
        at = 0
        for r, (i, x) in zip(found, rows, strict=True):
            ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], dtype="<u4")
            assert (-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)


def test_empty_table(spark):
    assert read_token_files(spark, write_token_files(docs(spark, []), PATH)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@given(st.lists(st.lists(st.sampled_from(list("aZ é́ \n\t.,!'s19#|\u00a0\u3000\x1c\0ßİ<>-") + ["<|endoftext|>", "<|startoftext|>"]), max_size=30).map("".join), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_chunks_encode_as_the_whole(name, texts):
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    assert ["".join(c) for c in cut(pa.array(texts)).to_pylist()] == texts
    encoder(path).forget()
    assert [x.tolist() for x in encoder(path).encode(pa.array(texts))] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
