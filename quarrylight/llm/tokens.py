"""Vectorised reading of words out of Arrow text columns.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``, which on
UTF-8 text is the same as the pattern ``[^\\x20\\x09-\\x0D]+``.  Everything here works on
whole byte buffers with numpy, so no Python object is made per word.  Texts are taken in
chunks of about ``CHUNK_BYTES``; one longer text is one chunk of its own, never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20_240_117).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_BYTE_VALUES = _BYTE_VALUES[LOWER]
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK_BYTES)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 8 * CHUNK_BYTES:  # tables for rare, huge texts are not kept
            _powers[base] = have
    return have[:n]


@dataclass
class Chunk:
    """Some consecutive rows of a text column, as bytes with row offsets."""

    first_row: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than rows, from 0

    @property
    def n_rows(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and for each row the index of its first word (one more at the end)."""
        n = len(self.data)
        if n == 0:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(len(self.offsets), dtype=np.int64)
        inside = ~SPACE[self.data]
        cut = np.zeros(n + 1, dtype=bool)  # a text begins here
        cut[self.offsets] = True
        cut = cut[:n]
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | cut))
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:] & ~cut[1:]
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word's bytes (of its A-Z lower-cased form, if asked)."""
        n = len(self.data)
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        terms = (_LOWER_BYTE_VALUES if lower else _BYTE_VALUES)[self.data]
        terms *= _power_table(_MULTIPLIER, n)
        np.cumsum(terms, out=sums[1:])
        out = sums[ends]
        out -= sums[starts]
        out *= _power_table(_INVERSE, n)[starts]
        return mix64(out)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column's rows in order; null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, raw_offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield Chunk(row, raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
        row = stop


def row_of_word(first_word: np.ndarray) -> np.ndarray:
    """The row of each word, from the rows' first words."""
    return np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))


def ngram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; those that run over a row's end are for the caller to leave out."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = word_hashes[:m].copy()
    for j in range(1, n):
        out *= np.uint64(_MULTIPLIER)
        out += word_hashes[j : j + m]
    return mix64(out)
