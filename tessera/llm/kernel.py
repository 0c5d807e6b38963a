"""Vectorised text kernels: words, word hashes and word windows straight from Arrow buffers.

All functions work on a run of whole texts laid end to end (``data``, bytes of UTF-8) with the
``offsets`` of each text, so that a task never builds a Python string per word.  A word's hash chains
its 8-byte pieces through a bijection of 64-bit values (so words of up to 8 bytes never collide);
words of over ``LONG`` bytes get a BLAKE2 digest.  A long text is cut at gaps between words, so what is
held per byte is bounded, whatever its length; the rest is a few numbers a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Bytes of a text that are looked at together, and bytes of a word beyond which it is digested whole.
PIECE, LONG = 4 << 20, 64

_U = np.uint64
_FACTORS = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], _U)


def _table(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Bytes between words: the white space of ``[^\x20\x09-\x0D]+``.
SPACE = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Bytes between words when punctuation doesn't count: ASCII that is neither letter nor digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
UPPER = _table(range(65, 91))
DIGIT = _table(range(48, 58))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of a run of texts: byte spans, hashes, and ``first[i]:first[i + 1]`` for text i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64's finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a string column in runs of about max_bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    _, offs, buf = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE, lower: bool = False, hashed: bool = True) -> Words:
    """The words of texts ``data[offsets[i]:offsets[i + 1]]``."""
    starts, ends, hashes = [], [], []
    for lo, hi in _pieces(data, offsets, between):
        part = LOWER[data[lo:hi]] if lower else data[lo:hi]
        inner = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "left")] - lo
        a, b = _spans(part, inner, between)
        if hashed:
            hashes.append(span_hashes(part, a, b))
        starts.append(a + lo)
        ends.append(b + lo)
    if not starts:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(len(offsets), np.int64), np.zeros(0, _U))
    start, end = (np.concatenate(x) if len(x) > 1 else x[0] for x in (starts, ends))
    h = (np.concatenate(hashes) if len(hashes) > 1 else hashes[0]) if hashed else np.zeros(0, _U)
    return Words(start, end, np.searchsorted(start, offsets), h)


def _pieces(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of about ``PIECE`` bytes that no word crosses."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + PIECE)
        while hi < n:
            gap = np.flatnonzero(between[data[hi : hi + PIECE]])
            at = int(np.searchsorted(offsets, hi, "left"))
            hi = min(hi + (int(gap[0]) if len(gap) else PIECE), int(offsets[at]) if at < len(offsets) else n, n)
            if len(gap) or hi == n or (at < len(offsets) and hi == offsets[at]):
                break
        yield lo, hi
        lo = hi


def _spans(data: np.ndarray, starts_of_texts: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 byte of each word; a word ends where a text starts."""
    n = len(data)
    gap = between[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[0] = after[-1] = True
    before[starts_of_texts] = True
    after[starts_of_texts[starts_of_texts > 0] - 1] = True
    word = ~gap
    return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand; another one a seed."""
    length = ends - starts
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)], padded[len(data) :] = data, 0
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each byte on
    h = mix(length.astype(_U) * _FACTORS[0] + _U(2 * seed + 1))
    h = mix(h ^ (eight[starts] & _MASKS[np.minimum(length, 8)]))
    more, at = np.flatnonzero(length > 8), 8
    while len(more) and at < LONG:
        piece = eight[starts[more] + at] & _MASKS[np.minimum(length[more] - at, 8)]
        h[more] = mix(h[more] * _FACTORS[1] ^ piece)
        at += 8
        more = more[length[more] > at]
    for i in more.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two neighbouring runs of words from theirs."""
    out = a * _FACTORS[2]
    out += b
    out ^= out >> _U(32)
    out *= _FACTORS[3]
    return out


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every window of ``width`` words inside one text.

    Runs of 1, 2, 4, ... words are joined to the width, so a window takes few steps.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    out, done, run, size = None, 0, hashes, 1
    while True:
        if width & size:
            out, done = run[:n] if out is None else _join(out, run[done : done + n]), done + size
        if done == width:
            break
        run, size = _join(run[:-size], run[size:]), size * 2
    text = owner(first)
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    return at, mix(out[at])


def covered(n_words: int, at: np.ndarray, width: int) -> np.ndarray:
    """Whether each of n_words words lies in a window of ``width`` that starts at one of ``at``."""
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


class Lookup:
    """Places of 64-bit hashes in a sorted array, found through buckets of their highest bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        """``hashes``: sorted and distinct."""
        self.hashes = hashes
        self._make_buckets()

    def _make_buckets(self) -> None:
        self.bits = int(np.clip(len(self.hashes).bit_length() + 2, 4, 22))
        edges = np.arange((1 << self.bits) + 1, dtype=np.uint64)
        self.bucket = np.searchsorted(self.hashes >> _U(64 - self.bits), edges).astype(np.int32)
        self.deepest = int(np.diff(self.bucket).max()) if len(self.hashes) else 0

    def __getstate__(self) -> np.ndarray:
        """The buckets are made anew where the table arrives."""
        return self.hashes

    def __setstate__(self, hashes: np.ndarray) -> None:
        self.__init__(hashes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        b = (h >> _U(64 - self.bits)).astype(np.int64)
        lo, hi = self.bucket[b].astype(np.int64), self.bucket[b + 1]
        open_ = np.flatnonzero(lo < hi)
        for _ in range(self.deepest):
            right = self.hashes[lo[open_]] == h[open_]
            out[open_[right]] = lo[open_[right]]
            open_ = open_[~right]
            lo[open_] += 1
            open_ = open_[lo[open_] < hi[open_]]
            if not len(open_):
                break
        return out
