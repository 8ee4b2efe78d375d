"""Words of a block of texts as arrays of 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and INVERSE to the powers from 0 to n - 1, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        for name, x in (("up", BASE), ("down", INVERSE)):
            a = np.full(max(n, 1 << 16), x, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column in lower case; null is the empty text."""
    column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    if column.offset:
        column = pa.concat_arrays([column])
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1).astype(np.int64)
    data = np.frombuffer(data, np.uint8, int(offsets[-1])) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] :], offsets - offsets[0]


#: Bytes of words: ASCII letters and digits, and whatever is part of a character beyond ASCII.
WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first): the runs of word bytes in order, where they stand in ``data``, and for each text the
    index of its first word, with the number of words at the end."""
    n = len(data)
    if not n:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e, np.zeros(len(offsets), np.int64)
    inside = WORD_BYTES[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < n]] = False  # a text's first byte begins a word whatever stands before it
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(data.astype(np.uint64) * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of runs of ``size`` words, index of each text's first run and their number at the end). A text of fewer words has one run of all it has; one without words has none."""
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(runs)])
    if not begin[-1]:
        return np.empty(0, np.uint64), begin
    at = np.repeat(first[:-1] - begin[:-1], runs) + np.arange(begin[-1])
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    end = np.repeat(first[1:], runs)
    total = np.zeros(begin[-1], np.uint64)
    for k in range(size):
        part = padded[at + k]
        part[at + k >= end] = 0  # beyond a short text
        total = (total ^ part) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1)
    return mix(total), begin
