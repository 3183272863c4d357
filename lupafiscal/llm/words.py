"""Words and their hashes for whole Arrow batches of texts, with numpy.

Texts stay one byte buffer; words are (start, end) positions in it.  Batches are
worked through in slices of a few megabytes, so memory does not follow the size
of a batch.  A hash is 64 bits; every use that must be exact says how it is
checked, or that it relies on 64 bits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_TABLE_DEPTH = 64
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters close ones (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))



@functools.cache
def _scattered(alphabet: int) -> np.ndarray:
    return mix(np.arange(alphabet * _TABLE_DEPTH, dtype=_U))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 byte values lie in the given inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


# Bytes from 0x80 on belong to characters beyond ASCII.
NOT_BLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LETTERS_DIGITS = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Texts:
    """A run of rows: their UTF-8 bytes end to end, and where each row starts."""

    first: int  # row number of the first one in its batch
    data: np.ndarray
    offsets: np.ndarray  # one more than rows

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = pc.fill_null(column.cast(kind), pa.scalar(b"", kind))
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), at


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column in runs of rows of about ``limit`` bytes, one row at least."""
    if not len(column):
        return
    data, at = buffers(column)
    low, rows = 0, len(at) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        high = min(high, rows)
        yield Texts(low, data[at[low] : at[high]], at[low : high + 1] - at[low])
        low = high


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # row r has the words from offsets[r] up to offsets[r + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def find(texts: Texts, members: np.ndarray) -> Words:
    """Maximal runs of member bytes; none reaches over the end of its row."""
    inside = members[texts.data]
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(texts.rows + 1, np.int64))
    opens = np.zeros(n + 1, dtype=bool)
    opens[texts.offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | opens[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | opens[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.offsets))


def hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alphabet: int = 256, limit: int = SLICE_BYTES
) -> np.ndarray:
    """A 64-bit hash of each run of symbols (none empty): a sum over symbols, mixed with their place."""
    out = np.zeros(len(starts), dtype=_U)
    if not len(starts):
        return out
    total = np.concatenate([[0], np.cumsum(ends - starts)])
    low = 0
    while low < len(starts):
        high = min(len(starts), max(low + 1, int(np.searchsorted(total, total[low] + limit, "right")) - 1))
        begins = total[low:high] - total[low]
        place = np.arange(total[high] - total[low]) - np.repeat(begins, ends[low:high] - starts[low:high])
        values = data[place + np.repeat(starts[low:high], ends[low:high] - starts[low:high])]
        key = place * alphabet + values
        short = int(place.max()) < _TABLE_DEPTH
        scattered = _scattered(alphabet)[key] if short else mix(key.astype(_U))
        out[low:high] = np.add.reduceat(scattered, begins)
        low = high
    return mix(out)


def grams(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each word on, also where they reach over a row's end; see ``whole``."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = word_hashes[:n].copy()
    for j in range(1, k):
        out *= _U(0x9E3779B97F4A7C15)
        out += word_hashes[j : n + j]
    return mix(out)


def whole(words: Words, k: int) -> np.ndarray:
    """At which words k words of the same row begin (as long as ``grams``)."""
    n = max(0, int(words.offsets[-1]) - k + 1)
    ends = np.repeat(words.offsets[1:], words.counts)[:n]
    return np.arange(n) + k <= ends


def char_positions(data: np.ndarray) -> np.ndarray:
    """For each byte and the end, how many characters begin before it."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key how often it occurs, and whether this is its first place."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    sizes = np.bincount(group, minlength=0)
    counts, first = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    counts[order], first[order] = sizes[group], new
    return counts, first
