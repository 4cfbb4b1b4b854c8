"""Vectorised access to the bytes and words of Arrow string columns.

Word and window fingerprints are Karp-Rabin hashes modulo 2**64 over random odd
byte codes, computed with prefix sums, so a batch needs no Python loop per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Separators of the word pattern [^\x20\x09-\x0D]+.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of the looser word pattern: everything ASCII but letters and digits.
_MARKS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32

_CODES = np.random.default_rng(20240131).integers(1, 2**63 - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of text whose hashes are computed at once.
PIECE = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    base %= 1 << 64
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 4 * PIECE:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each number is among the sorted known ones."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its len + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def parts(offsets: np.ndarray, limit: int):
    """Ranges of rows (i, j) of about limit bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values, dtype=np.uint64, out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, loose: bool = False):
    """(hash, start, end) of every word and the word offsets of the rows.

    lower folds A-Z; loose takes runs of ASCII letters, digits and non-ASCII bytes
    in place of runs of anything but white space.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, np.zeros(len(offsets), np.int64)
    inside = ~(_MARKS if loose else _BLANK)[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = True
    first &= inside
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    last[edges - 1] = True
    last &= inside
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(start), np.uint64)
    codes = _CODES[_LOWER if lower else _SAME]
    inverse = pow(_BYTE_BASE, -1, 1 << 64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        base, stop = int(start[i]), int(end[j - 1])
        sums = prefix(codes[data[base:stop]] * powers(_BYTE_BASE, stop - base))
        s, e = start[i:j] - base, end[i:j] - base
        hashes[i:j] = mix((sums[e] - sums[s]) * powers(inverse, stop - base)[s] + (e - s).astype(np.uint64))
        i = j
    return hashes, start, end, np.searchsorted(start, offsets, "left").astype(np.int64)


def windows(hashes: np.ndarray, offsets: np.ndarray, k: int, whole: bool = False):
    """(hash, index of the first word, row) of every run of k words inside a row.

    whole: a row of 1 to k - 1 words gives its whole sequence as one run.
    """
    n = len(hashes)
    sums = prefix(hashes * powers(_WORD_BASE, n))
    counts = np.diff(offsets)
    have = np.maximum(counts - k + 1, 0)
    if whole:
        have = np.where((counts > 0) & (counts < k), 1, have)
    rows = np.repeat(np.arange(len(counts)), have)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(have) - have, have) + np.repeat(offsets[:-1], have)
    length = np.minimum(k, counts)[rows]
    inverse = pow(_WORD_BASE, -1, 1 << 64)
    return mix((sums[at + length] - sums[at]) * powers(inverse, n + 1)[at] + length.astype(np.uint64)), at, rows
