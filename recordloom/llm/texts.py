"""Byte-level helpers for work inside Arrow tasks: word bounds, rolling hashes, cuts of batches.

Everything here works on one bounded cut of a batch (a few MB of text), never on a whole table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: An odd multiplier for rolling hashes and the constants of the splitmix64 finaliser.
MULTIPLIER = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

# One large array that is given back at once: the C library then keeps freed memory for later arrays of up to this size,
# where it would else return and fault in the pages of every one (that took three quarters of the time).
np.empty(1 << 24, np.uint8)

#: Bytes of text worked on at once: arrays of eight bytes for each byte then stay in a core's cache.
CUT_BYTES = 1 << 16

_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each 64-bit value; one to one."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


def byte_codes(lane: int = 0) -> np.ndarray:
    """A fixed 64-bit value for each byte; other ones for each lane."""
    return mix(np.arange(1 + 256 * lane, 257 + 256 * lane, dtype=np.uint64) * np.uint64(MULTIPLIER))


def space_table() -> np.ndarray:
    """True for each byte that belongs to a word, if words are what white space separates."""
    table = np.ones(256, dtype=bool)
    table[list(_SPACES)] = False
    return table


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cuts(offsets: np.ndarray, limit: int = CUT_BYTES):
    """Row ranges (i, j) whose texts hold about ``limit`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray):
    """Start, end and row of every maximal run of word bytes; runs end with their text."""
    mask = in_word[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    first[edges] = mask[edges]
    last[edges - 1] = mask[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A code for each pair of codes. Not linear in them, so equal sums of codes do not make equal hashes."""
    x = left * np.uint64(MULTIPLIER)
    x += right
    x ^= x >> np.uint64(29)
    x *= np.uint64(MIX_1)
    return x


class Rolling:
    """Hashes of any slice of a sequence of 64-bit codes.

    Level k has a hash for each 2**k codes, made of two hashes of the level below. A slice is told by the two hashes of
    the highest level that begin and end with it, and by its length. Levels of a long sequence are not kept.
    """

    def __init__(self, codes: np.ndarray):
        self.levels = [np.asarray(codes, np.uint64)]

    def _upto(self, most: int):
        """Levels 0 to most."""
        level = self.levels[0]
        for k in range(most + 1):
            if k < len(self.levels):
                level = self.levels[k]
            else:
                level = _joined(level[: -(1 << (k - 1))], level[1 << (k - 1) :])
                if len(self.levels[0]) <= 4 * CUT_BYTES:
                    self.levels.append(level)
            yield level

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of codes[start:end] for each pair, with the length in it."""
        starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
        size = ends - starts
        height = np.frexp(size.astype(np.float64))[1] - 1  # -1 for an empty slice
        low, high = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        for k, level in enumerate(self._upto(int(height.max(initial=-1)))):
            here = np.flatnonzero(height == k)
            low[here], high[here] = level[starts[here]], level[ends[here] - (1 << k)]
        return mix(_joined(low, high) + size.astype(np.uint64) * np.uint64(MIX_2))

    def windows(self, width: int) -> np.ndarray:
        """slices() for every start, all of one width."""
        k = width.bit_length() - 1
        *_, level = self._upto(k)
        n = len(self.levels[0]) - width + 1
        return mix(_joined(level[:n], level[width - (1 << k) :][:n]) + np.uint64(width * MIX_2 % (1 << 64)))


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return Rolling(byte_codes(lane)[data]).slices(starts, ends)


def gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many spans, end to end."""
    return data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether data[a:a + size] is data[b:b + size], byte by byte, for all pairs; a bounded number of bytes at a time."""
    total, i = np.r_[0, np.cumsum(size)], 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, total[i] + (1 << 20), "right")) - 1)
        if j == i + 1:
            if not np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]]):
                return False
        elif not np.array_equal(gathered(data, a[i:j], size[i:j]), gathered(data, b[i:j], size[i:j])):
            return False
        i = j
    return True


def bit_counts(hashes: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the hashes of each row: hashes[at[r] : at[r] + count[r]].

    Eight counters of a byte stand side by side in 64 bits, so rows are summed in parts of 255 at most.
    """
    parts = -(-count // 255)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(at, parts) + 255 * nth
    out = np.zeros((len(at), 8, 8), np.int64)
    first = np.cumsum(parts) - parts
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), begin)
        out[:, :, k] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out.reshape(len(at), 64)


def majority(hashes: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row (of one hash or more): the bits that are set in over half of its hashes."""
    if not len(at):
        return np.zeros(0, np.uint64)
    return np.packbits(2 * bit_counts(hashes, at, count) > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def xxh64_long(values: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for bigint values (XXH64 of eight bytes, seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, by):
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    x = np.asarray(values, np.int64).view(np.uint64)
    h = np.full(len(x), 42 + int(p5) + 8, np.uint64) ^ (turned(x * p2, 31) * p1)
    h = turned(h, 27) * p1 + p4
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    h ^= h >> np.uint64(32)
    return h.view(np.int64)
