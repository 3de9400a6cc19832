"""Hashed pieces of words: what the learned classifiers count in a text."""

from __future__ import annotations

import numpy as np

from .texts import MULTIPLIER, Rolling, byte_codes, mix, space_table, word_bounds


#: Bucket of the piece that stands for "the same word once more".
ECHO = 5


def lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    table[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
    return table


def pieces(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], words: bool, bits: int):
    """(place of the first byte, bucket) of all byte n-grams that do not reach across a word, of whole words, and of words that repeat the one before.

    An n-gram may begin or end with the blank beside its word. A to Z count as lower case. Buckets are
    0 .. 2**bits - 1.
    """
    data = lowered()[data]
    rolling = Rolling(byte_codes()[data])
    blank = np.r_[0, np.cumsum(data == 0x20)]
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    shift = np.uint64(64 - bits)
    for n in sizes:
        if len(data) < n:
            continue
        at = np.arange(len(data) - n + 1)
        inner = blank[n - 1 : len(data)] - blank[1 : len(data) - n + 2]
        at = at[(inner == 0) & (at + n <= row_end[: len(at)])]
        yield at, (rolling.slices(at, at + n) * np.uint64(MULTIPLIER) >> shift).astype(np.int64)
    if words:
        starts, ends, row = word_bounds(data, offsets, space_table())
        codes = rolling.slices(starts, ends)
        yield starts, (mix(codes) >> shift).astype(np.int64)
        echo = starts[1:][(codes[1:] == codes[:-1]) & (row[1:] == row[:-1])]
        yield echo, np.full(len(echo), ECHO % (1 << bits))


def counts_by_row(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], words: bool, bits: int) -> np.ndarray:
    """Rows by buckets: how often each piece stands in each text."""
    n, width = len(offsets) - 1, 1 << bits
    out = np.zeros((n, width), np.float32)
    for at, bucket in pieces(data, offsets, sizes, words, bits):
        row = np.searchsorted(offsets, at, "right") - 1
        out += np.bincount(row * width + bucket, minlength=n * width).reshape(n, width)
    return out
