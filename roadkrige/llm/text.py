"""Vectorised work on the UTF-8 bytes of whole Arrow columns.

A word is a maximal run of bytes other than space and 0x09-0x0D.  All of
these separators are ASCII, so words can be found in the bytes of a UTF-8
text.  Within a block of texts words are told apart by their bytes (Arrow's
dictionary encoding).  Where words or runs of words must be recognised across
tasks, each word gets 128 bits, and runs are folded from pairs of shorter runs.
All hashes are two independent halves of 64 bits that a non-linear mixer makes
of eight bytes after another (XXH3 for very long words); none is a polynomial,
so no pattern of letters or words cancels out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"
BLOCK = 1 << 20  # bytes of text worked on at once; a longer text is a block of its own
LONG_WORD = 512  # bytes up to which words are hashed in numpy

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
_FOLD = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))  # odd multipliers of the two halves


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[at[0] : at[-1]], at - at[0]) if len(at) else (raw[:0], np.zeros(1, np.int64))


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes, a longer row alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


class Words:
    """The words of a block of texts: starts, ends and, by text, first word and end.

    ``cuts`` marks bytes within words at which a word is cut further.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~_IS_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = offsets[1:-1][offsets[1:-1] < n]
        begins[cut] |= inside[cut]
        if cuts is not None:
            begins |= cuts
        self.inside = inside
        self.starts = np.flatnonzero(begins)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cut = cut[cut > 0] - 1
        ends[cut] |= inside[cut]
        if cuts is not None:
            ends[:-1] |= cuts[1:]
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of n + 1 texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def column(self, data: np.ndarray | None = None) -> pa.Array:
        """The bytes of every word (taken from ``data``, if given, which has a byte for each of the texts')."""
        raw = self.data if data is None else data
        return spans(raw[self.inside], self.ends - self.starts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """128 bits for each word, as two rows, A-Z taken as a-z where ``lower``."""
        return span_hashes(LOWER[self.data] if lower else self.data, self.starts, self.ends - self.starts)


def spans(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive spans of ``data`` as a binary column."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def span_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits for each span of bytes, as two rows, equal for equal bytes wherever they stand."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = np.stack([sizes.astype(np.uint64) + np.uint64(p) for p, _ in _FOLD])
    live, at, left = np.arange(len(starts)), starts, sizes
    for _ in range(LONG_WORD // 8):
        live, at, left = (x[left > 0] for x in (live, at, left))
        if not len(live):
            return out
        piece = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
        for half, (p, q) in zip(out, _FOLD, strict=True):
            half[live] = mix(half[live] * np.uint64(p) + mix(piece ^ np.uint64(q)))
        at, left = at + 8, left - 8
    for i in live[left > 0].tolist():
        out[:, i] = np.frombuffer(xxhash.xxh3_128_digest(data[starts[i] : starts[i] + sizes[i]].tobytes()), dtype="<u8")
    return out


class Known:
    """Slots of byte strings met before: 0, 1, ... in the order in which they were added.

    Strings are looked up by a hash, and each hit is compared by its bytes; of
    strings with equal hashes only one is kept.
    """

    def __init__(self):
        self.keys, self.slots, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.large_binary())

    def __len__(self) -> int:
        return len(self.slots)

    @staticmethod
    def key(column: pa.Array) -> np.ndarray:
        data, offsets = column_bytes(column)
        return span_hashes(data, offsets[:-1], np.diff(offsets))[0]

    def find(self, column: pa.Array, key: np.ndarray) -> np.ndarray:
        """The slot of each string, -1 where it is unknown."""
        if not len(self):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self) - 1)
        slot = self.slots[at]
        same = pc.equal(column, self.values.take(pa.array(slot))).to_numpy(zero_copy_only=False)
        return np.where(same, slot, -1)

    def add(self, column: pa.Array, key: np.ndarray) -> np.ndarray:
        """Add the distinct strings that were not found; which of them were added, in order."""
        key, first = np.unique(key, return_index=True)
        at = np.searchsorted(self.keys, key)
        free = np.ones(len(key), dtype=bool) if not len(self) else self.keys[np.minimum(at, len(self) - 1)] != key
        key, first, at = key[free], first[free], at[free]
        order = np.argsort(first)
        slot = np.empty(len(key), dtype=np.int64)
        slot[order] = len(self) + np.arange(len(key))
        self.values = pa.concat_arrays([self.values, column.take(pa.array(first[order]))])
        self.keys, self.slots = np.insert(self.keys, at, key), np.insert(self.slots, at, slot)
        return first[order]


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes (two rows) of ``a`` followed by ``b``."""
    return np.stack([mix(mix(x * np.uint64(p)) + y * np.uint64(q)) for x, y, (p, q) in zip(a, b, _FOLD, strict=True)])


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Column i covers words i to i + k - 1; there are n - k + 1 of them (none if fewer words).

    A run is the pair of its first and last 2**j words, 2**j at least half of it.
    """
    if words.shape[1] < k:
        return words[:, :0]
    size, out = 1, words
    while 2 * size <= k:
        out = pair(out[:, :-size], out[:, size:])
        size *= 2
    rest = k - size
    return pair(out[:, : out.shape[1] - rest], out[:, rest:]) if rest else out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 of all i, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)
