"""Text as byte arrays: the vectorised primitives that the Arrow-batched operators share.

A batch of texts is one UTF-8 buffer with document offsets.  Words, word hashes and
n-gram hashes are computed for all of it at once, eight bytes or one joint at a time, so
cost is a few passes over the bytes and a Python loop runs only for words of over LONG bytes.
Hashes only find candidates: where a decision rests on equality, same_words() compares bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 1  # runs of ASCII letters, ASCII digits and non-ASCII characters, A-Z lower-cased
SPACED = 2  # runs of anything but the six ASCII white-space characters

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes than this are hashed one by one with a cryptographic hash.
LONG = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True
_IS_SPACED = np.ones(256, bool)
_IS_SPACED[[32, 9, 10, 11, 12, 13]] = False
_LETTER_HASH = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 32))[_LOWER]
#: By the bytes that are left of a word: what to keep of eight bytes read.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_CLASS = {WORDS: _IS_WORD, SPACED: _IS_SPACED}


class Batch:
    """UTF-8 bytes of several texts end to end, with offsets (n + 1 of them)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    @classmethod
    def of_strings(cls, texts: list[str | None]) -> Batch:
        return cls.of_arrow(pa.array(texts, pa.string()))

    @classmethod
    def of_arrow(cls, column: pa.Array) -> Batch:
        """Null texts become empty ones."""
        if column.null_count:
            column = column.fill_null("")
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        _, where, what = column.buffers()
        if not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        off = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(what, np.uint8)[off[0] : off[-1]] if what is not None else np.zeros(0, np.uint8)
        return cls(data, off - off[0])

    def words(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, doc) of every word, in text order."""
        inside = _CLASS[kind][self.data]
        n = len(inside)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        edge = np.empty(n + 1, bool)
        edge[0], edge[n] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
        cuts = self.offsets[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
        cuts = cuts[inside[cuts] & inside[cuts - 1]]  # one text ends and the next begins inside a run
        at = np.flatnonzero(edge)
        if len(cuts):
            at = np.sort(np.concatenate([at, cuts, cuts]))
        starts, ends = at[0::2], at[1::2]
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def _blocks(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes as words of this kind compare, the eight bytes that begin at each of them as one number)."""
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[:-8] = _LOWER[self.data] if kind == WORDS else self.data
        return padded, np.ndarray((len(self.data) + 1,), "<u8", buffer=padded, strides=(1,))

    def word_hashes(self, kind: int, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; seeds give independent ones.

        Eight bytes at a time go through a mixer, so no sum or polynomial can cancel; a word
        of more than LONG bytes gets a keyed cryptographic hash.
        """
        padded, eight = self._blocks(kind)
        length = ends - starts
        out = mix(length.astype(np.uint64) * _ODD + np.uint64(seed * 2 + 1))
        todo, at = np.flatnonzero(length <= LONG), 0
        while len(todo):
            left = length[todo] - at
            block = eight[starts[todo] + at] & _KEEP[np.minimum(left, 8)]
            out[todo] = mix((out[todo] * _ODD) ^ block)
            at += 8
            todo = todo[left > 8]
        for i in np.flatnonzero(length > LONG).tolist():
            raw = padded[starts[i] : ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=b"%d" % seed).digest(), "little")
        return out

    def same_words(self, kind: int, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether each word has the same bytes as word other[i]."""
        padded, eight = self._blocks(kind)
        length = ends - starts
        out = length == length[other]
        todo, at = np.flatnonzero(out & (length <= LONG) & (other != np.arange(len(other)))), 0
        while len(todo):
            left = length[todo] - at
            keep = _KEEP[np.minimum(left, 8)]
            out[todo] &= eight[starts[todo] + at] & keep == eight[starts[other[todo]] + at] & keep
            at += 8
            todo = todo[left > 8]
        for i in np.flatnonzero(out & (length > LONG) & (other != np.arange(len(other)))).tolist():
            j = other[i]
            out[i] = padded[starts[i] : ends[i]].tobytes() == padded[starts[j] : ends[j]].tobytes()
        return out

    def distinct_words(self, kind: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each distinct one, the number of the distinct one of each word): by hash, then checked byte for byte."""
        _, first, index = np.unique(self.word_hashes(kind, starts, ends), return_index=True, return_inverse=True)
        odd = np.flatnonzero(~self.same_words(kind, starts, ends, first[index]))
        if len(odd):  # words that share a hash with another
            padded, more = self._blocks(kind)[0], {}
            for i in odd.tolist():
                raw = padded[starts[i] : ends[i]].tobytes()
                index[i] = more.setdefault(raw, (len(first) + len(more), i))[0]
            first = np.concatenate([first, [i for _, i in more.values()]])
        return first, index

    def code_points(self) -> tuple[np.ndarray, np.ndarray]:
        """(code points, offsets in code points)."""
        lead = (self.data & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(lead)])
        points = np.frombuffer(self.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        return points, before[self.offsets]

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two things one after the other, of theirs."""
    return mix((a * _ODD) ^ b)


def runs(item: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive items: halves are joined, quarters, ..., and each joint goes through the mixer."""
    n, out, done, piece, size = len(item) - k + 1, None, 0, item, 1
    while True:
        if k & size:
            part = piece[done : done + n]
            out = part if out is None else joined(out, part)
            done += size
        size *= 2
        if size > k:
            return out
        piece = joined(piece[: -(size // 2)], piece[size // 2 :])


def grams(word_hash: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first word's index) of every k consecutive words that lie in one document."""
    n = len(word_hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    return runs(word_hash, k)[at], at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each span, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def release() -> None:
    """Gives memory back at a task's end: workers are used again by later stages, beside others."""
    gc.collect()
    trim()


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about most_bytes of text each; a text is never divided."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.maximum(1, pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])
