import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cpgdomains.llm.packing import Limits, Packer, Piece, pack_documents

from .data import ODD, docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array([*e.ids, 2], dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_every_id_lies_in_one_piece(spark):
    rows = [(i, t) for i, (_, t) in enumerate(ODD)]
    found = pack_documents(docs(spark, rows), PATH, ids=True).collect()
    want = expected([t for _, t in rows])
    for i, ids in enumerate(want):
        pieces = sorted((r for r in found if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert sum(r.length for r in pieces) == len(ids) and all(r.doc_tokens == len(ids) for r in pieces)
        for r in pieces:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.ids == ids[r.start : r.start + r.length].tolist()
    for s in {r.sequence_id for r in found}:
        inside = sorted((r for r in found if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in inside] == np.cumsum([0, *(r.length for r in inside)])[:-1].tolist()
        total = sum(r.length for r in inside)
        assert total <= 4096 and total & (total - 1) == 0


def test_null_and_repeated_ids(spark):
    found = pack_documents(docs(spark, [(None, "a b"), (1, "a"), (1, "a"), (2, None)]), PATH).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in found if r.start == 0) == [(False, 1), (False, 2), (False, 2), (True, 3)]


def test_empty_table(spark):
    assert pack_documents(docs(spark, []), PATH).count() == 0


@pytest.mark.parametrize("limits", [Limits(64, 3, 64, 4), Limits(64, 100, 20, 2), Limits(32, 5, 10, 8)])
def test_limits_hold_at_once(limits):
    rng = np.random.default_rng(7)
    packer, total = Packer(limits), 0
    for d in range(300):
        n = int(rng.integers(1, 150))
        total += n
        packer.add(Piece(d, 0, np.arange(n, dtype=np.uint32), n, int(rng.integers(0, n + 1))))
    packer.finish()
    assert sum(len(p.ids) for s in packer.closed for p in s) == total
    for s in packer.closed:
        assert s and sum(len(p.ids) for p in s) <= limits.tokens and len(s) <= limits.segments and sum(p.loss() for p in s) <= limits.loss


def test_dot_product_prefers_the_matching_bin():
    packer = Packer(Limits(100, 10, 50, 4))
    packer.add(Piece(1, 0, np.zeros(60, np.uint32), 60, 60))  # no loss: room (40, 9, 50)
    packer._open()
    packer._put(1, Piece(2, 0, np.zeros(10, np.uint32), 10, 0))  # room (90, 9, 40)
    packer.add(Piece(3, 0, np.zeros(30, np.uint32), 30, 29))  # needs tokens
    assert [p.doc for p in packer.bins[1]] == [2, 3]


def test_prompt_tokens_bear_no_loss(spark):
    found = pack_documents(docs(spark, [(1, "a b c d e")]), PATH, prompt_tokens=F.lit(4)).collect()
    assert sum(r.loss_tokens for r in found) == 2 and sum(r.length for r in found) == 6


def test_a_loss_limit_binds_on_documents_with_prompts(spark):
    """Half of each document is its prompt; sequences may hold 600 tokens that bear loss, which comes before 4096 tokens."""
    rows = [(i, " ".join(f"word{j}" for j in range(20 + 7 * i))) for i in range(60)]
    limits = Limits(loss=600)
    found = pack_documents(docs(spark, rows).repartition(1), PATH, limits=limits, prompt_tokens=F.length("text") / 8).collect()
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append(r)
    loss = [sum(r.loss_tokens for r in x) for x in by.values()]
    assert max(loss) <= 600 and sum(x == 600 for x in loss) > len(loss) / 2
    assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0)
    assert all(sum(r.length for r in x) <= 4096 and len(x) <= limits.segments for x in by.values())


def test_little_padding(spark):
    found = pack_documents(docs(spark, [(i, "some words " * (1 + i * 37 % 900)) for i in range(200)]), PATH).collect()
    by = {}
    for r in found:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    padded = sum(4096 - n for n in by.values() if n & (n - 1))
    assert padded <= 0.01 * sum(by.values())
