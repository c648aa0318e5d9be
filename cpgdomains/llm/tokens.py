"""Whole-text encoding by the tokenizers library, one call per distinct chunk.

A text is cut before single spaces between two characters that aren't white space, and between a letter and a common
punctuation mark. At such a place the pre-tokenisers of both kinds of file always begin a new pre-token and never look
back, so encoding chunk by chunk gives the ids of the whole text. Arrow cuts a batch and numbers its distinct chunks; those
not met before are encoded together. The table of chunks, found by hashes and compared by bytes, lives as long as the worker and is bounded.

Tokens that a file adds to its vocabulary, such as an end-of-text mark, are found in a text as the library finds them by default:
their strings become their ids. A text that holds such a string is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import mixed, powers, raw, release, slices

_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space beside white space or an end, or the cut mark: such texts are cut by the slower rule.
_ODD = rf"[{_WHITE}] | [{_WHITE}]|^ | $|\x00"
_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:|%$&*#\n])"
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Chunks that may follow any that doesn't end in white space, and those that may follow a letter, so that a text of them is cut between them.
_AFTER_ANY = rf"(?s)^ [^{_WHITE}](.*[^{_WHITE}])?$"
_AFTER_LETTER = rf"(?s)^[.,!?;:|%$&*#\n](.*[^{_WHITE}])?$"
_LETTER = r"[A-Za-zÀ-ÖØ-öø-ÿ]$"
#: Chunks that a worker remembers at most, and bytes of text cut at once.
REMEMBERED, AT_ONCE = 1_000_000, 4 << 20
_loaded: dict[str, "ChunkEncoder"] = {}
_BYTE = np.random.default_rng(7_041).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xC6A4A7935BD1E995


def cut(texts: pa.Array) -> pa.ListArray:
    """Each text's chunks; joined they are the text."""
    odd = pc.match_substring_regex(texts, _ODD)
    plain = pc.if_else(odd, "", texts)
    marked = pc.replace_substring_regex(pc.replace_substring(plain, " ", "\0 "), _MARK, "\\1\0\\2")
    out = pc.split_pattern(marked, "\0")
    if pc.any(odd).as_py():
        rows = out.to_pylist()
        for i in pc.indices_nonzero(odd).to_pylist():
            rows[i] = _CUT.split(texts[i].as_py())
        out = pa.array(rows, out.type)
    return out


def hashes(texts: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    data, offsets = raw(texts.cast(pa.binary()))
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, j in slices(np.diff(offsets), 1 << 20):
        at = offsets[i : j + 1] - offsets[i]
        own = data[offsets[i] : offsets[j]]
        sums = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[own] * powers(_BASE, len(own)), out=sums[1:])
        back = powers(pow(_BASE, -1, 2**64), len(own) + 1)
        out[i:j] = mixed((sums[at[1:]] - sums[at[:-1]]) * back[at[:-1]] + np.diff(at).astype(np.uint64))
    return out


class ChunkEncoder:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        widths = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            widths[i] = len(token)
        probe = " A b\u00e9 ,.1"
        ids = self.tokenizer.encode(probe, add_special_tokens=False).ids
        # a lossless byte-level vocabulary: a token's length is its number of bytes
        self.widths = widths if int(widths[ids].sum()) == len(probe.encode()) else None
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.sorted, self.which = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and whose they are
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 15, dtype=np.int64)  # ends[k] to ends[k + 1]: where chunk k's ids lie
        self.n = 0

    def _grow(self, name: str, size: int) -> None:
        old = getattr(self, name)
        if size > len(old):
            new = np.zeros(max(size, len(old) * 3 // 2), dtype=old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _ids(self, part: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each chunk). Chunks that join are encoded as one text and told apart by their bytes."""
        if joined:
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            stops = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(c.encode()) for c in part])) + 1
            return ids, np.diff(stops, prepend=0)
        e = self.tokenizer.encode_batch([part], is_pretokenized=True, add_special_tokens=False)[0]
        return np.array(e.ids, dtype=np.uint32), np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(part))

    @staticmethod
    def _together(new: pa.Array) -> np.ndarray:
        """Chunks in an order in which they can be encoded as one text: each mark follows a letter, at an odd place."""
        has = lambda pattern: pc.match_substring_regex(new, pattern).to_numpy(zero_copy_only=False)
        free, mark, letter = has(_AFTER_ANY), has(_AFTER_LETTER) & ~has(r"^\n$"), has(_LETTER)
        a, b = np.flatnonzero(free & letter), np.flatnonzero(mark)
        n = min(len(a), len(b))
        pairs = np.stack([a[:n], b[:n]], axis=1).ravel()
        return np.concatenate([pairs, a[n:], np.flatnonzero(free & ~letter)])

    def learn(self, new: pa.Array, h: np.ndarray) -> np.ndarray:
        """Encodes chunks with hashes ``h`` and returns the numbers they get."""
        numbers, first = np.zeros(len(new), dtype=np.int64), self.n
        together = self._together(new) if self.widths is not None else np.zeros(0, np.int64)
        alone = np.ones(len(new), dtype=bool)
        alone[together] = False
        for joined, which in ((True, together), (False, np.flatnonzero(alone))):
            numbers[which] = self.n + np.arange(len(which))
            part = new.take(pa.array(which))
            self.known = pa.concat_arrays([self.known, part])
            for i in range(0, len(part), 4096):
                ids, counts = self._ids(part.slice(i, 4096).to_pylist(), joined)
                at = int(self.ends[self.n])
                self._grow("ids", at + len(ids))
                self._grow("ends", self.n + len(counts) + 1)
                self.ids[at : at + len(ids)] = ids
                self.ends[self.n + 1 : self.n + len(counts) + 1] = at + np.cumsum(counts)
                self.n += len(counts)
        assert self.n == first + len(new) == len(self.known)
        by = np.argsort(h)
        at = np.searchsorted(self.sorted, h[by])
        self.sorted, self.which = np.insert(self.sorted, at, h[by]), np.insert(self.which, at, numbers[by])
        return numbers

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        """Each distinct chunk's number; unknown ones are learned."""
        if self.n > REMEMBERED:
            self.forget()
        h = hashes(distinct)
        by = np.argsort(h)
        place = np.zeros(len(h), dtype=np.int64)
        place[by] = np.searchsorted(self.sorted, h[by])
        inside = np.minimum(place, max(0, len(self.sorted) - 1))
        hit = self.sorted[inside] == h if len(self.sorted) else np.zeros(len(h), dtype=bool)
        out = np.zeros(len(h), dtype=np.int64)
        out[hit] = self.which[inside[hit]]
        # a chunk whose hash another one has is learned again each time
        hit[hit] = pc.equal(self.known.take(pa.array(out[hit])), distinct.filter(pa.array(hit))).to_numpy(zero_copy_only=False)
        if not hit.all():
            out[~hit] = self.learn(distinct.filter(pa.array(~hit)), h[~hit])
        return out

    def encode(self, texts: pa.Array | pa.ChunkedArray, end: int | None = None) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers, ``end`` appended."""
        if isinstance(texts, pa.ChunkedArray):
            for part in texts.chunks:
                yield from self.encode(part, end)
            return
        tail = np.array([] if end is None else [end], dtype=np.uint32)
        whole = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if whole.any():
            for flag, text in zip(whole.tolist(), texts, strict=True):
                if flag:
                    yield np.array([*self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, *tail.tolist()], dtype=np.uint32)
                else:
                    yield from self.encode(pa.array([text.as_py()], texts.type), end)
            return
        for i, j in slices(pc.binary_length(texts).to_numpy(), AT_ONCE):
            chunks = cut(texts.slice(i, j - i))
            bounds = chunks.offsets.to_numpy()
            numbered = pc.dictionary_encode(chunks.flatten())
            which = self.numbers(numbered.dictionary)[numbered.indices.to_numpy()]
            starts, lengths = self.ends[which], self.ends[which + 1] - self.ends[which]
            stops = np.concatenate([[0], np.cumsum(lengths)])
            ids = self.ids[np.repeat(starts - stops[:-1], lengths) + np.arange(stops[-1])]
            at = stops[bounds - bounds[0]].tolist()
            del chunks, numbered, which, starts, lengths
            for s, e in zip(at, at[1:]):
                yield np.concatenate([ids[s:e], tail])
        release()


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]
