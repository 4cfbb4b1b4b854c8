"""Suffix arrays by induced sorting, in whole-bucket steps of numpy.

sais() sorts all suffixes of an integer array: it classifies suffixes as smaller or
larger than the next, sorts the leftmost-smaller substrings by one induction, names
them, sorts the reduced string recursively, and induces the order of all suffixes from
it. With a small alphabet, a bucket's entries are induced at once; the long alphabets of
reduced strings, whose buckets hold a few entries, are induced entry by entry.
"""

from __future__ import annotations

import numpy as np

#: Mean bucket size from which buckets are induced at once.
DENSE = 1000


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last, a sentinel, is."""
    n = len(s)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    step[-1] = 1
    # Where neighbours are equal the nearest decision to the right holds.
    at = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _place(p: np.ndarray, c: np.ndarray, sa: np.ndarray, ends: np.ndarray, sign: int) -> None:
    """Puts suffixes p with first letters c, in order, at the moving ends of their buckets."""
    order = np.argsort(c, kind="stable")
    c, p = c[order], p[order]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    count = np.diff(np.append(first, len(c)))
    offset = np.arange(len(c)) - np.repeat(first, count)
    letters = c[first]
    sa[np.repeat(ends[letters], count) + sign * offset] = p
    ends[letters] += sign * count


def _induce_dense(s, small, lms, sa, edges):
    """sa from the order of the leftmost-smaller suffixes: larger ones from the left, then smaller ones from the right."""
    k = len(edges) - 1
    sa.fill(-1)
    tails = edges[1:] - 1
    _place(lms[::-1], s[lms[::-1]], sa, tails.copy(), -1)
    heads = edges[:-1].copy()
    for c in range(k):
        lo, hi = edges[c], edges[c + 1]
        if lo == hi:
            continue
        done = lo
        while done < heads[c]:
            stop = int(heads[c])
            p = sa[done:stop] - 1
            done = stop
            p = p[p >= 0]
            p = p[~small[p]]
            if len(p):
                _place(p, s[p], sa, heads, 1)
        p = sa[done:hi]
        p = p[p > 0] - 1
        p = p[~small[p]]
        if len(p):
            _place(p, s[p], sa, heads, 1)
    rest = edges[1:] - 1
    for c in range(k - 1, -1, -1):
        lo, hi, larger = edges[c], edges[c + 1], int(heads[c])
        if lo == hi:
            continue
        done = hi - 1
        while done > rest[c]:
            stop = int(rest[c])
            p = sa[stop + 1 : done + 1][::-1] - 1
            done = stop
            p = p[p >= 0]
            p = p[small[p]]
            if len(p):
                _place(p, s[p], sa, rest, -1)
        p = sa[lo:larger][::-1]
        p = p[p > 0] - 1
        p = p[small[p]]
        if len(p):
            _place(p, s[p], sa, rest, -1)


def _induce_sparse(s, small, lms, sa, edges):
    text, is_small, out = s.tolist(), small.tolist(), [-1] * len(s)
    ends = (edges[1:] - 1).tolist()
    for p in lms[::-1].tolist():
        c = text[p]
        out[ends[c]] = p
        ends[c] -= 1
    heads = edges[:-1].tolist()
    for i in range(len(out)):
        p = out[i] - 1
        if p >= 0 and not is_small[p]:
            c = text[p]
            out[heads[c]] = p
            heads[c] += 1
    ends = (edges[1:] - 1).tolist()
    for i in range(len(out) - 1, -1, -1):
        p = out[i] - 1
        if p >= 0 and is_small[p]:
            c = text[p]
            out[ends[c]] = p
            ends[c] -= 1
    sa[:] = out


def _induce(s, small, lms, sa, edges):
    (_induce_dense if len(s) >= DENSE * (len(edges) - 1) else _induce_sparse)(s, small, lms, sa, edges)
    # The sentinel is the smallest suffix of all.
    sa[0] = len(s) - 1


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the leftmost-smaller substrings, by text order; equal substrings share one."""
    n = len(s)
    following = np.empty(n, np.int32)
    following[lms] = np.append(lms[1:], n - 1)
    length = following[order] - order + 1
    differ = np.ones(len(order), bool)
    differ[1:] = length[1:] != length[:-1]
    live = np.flatnonzero(~differ)
    k = 0
    while len(live):
        a, b = order[live - 1], order[live]
        unequal = s[a + k] != s[b + k]
        differ[live[unequal]] = True
        k += 1
        live = live[~unequal]
        live = live[k < length[live]]
    rank = np.cumsum(differ) - 1
    name = np.empty(n, np.int32)
    name[order] = rank
    return name[lms], int(rank[-1]) + 1


def sais(s: np.ndarray, letters: int) -> np.ndarray:
    """Suffix array of s, whose last item is a sentinel 0 that occurs nowhere else; items are below letters."""
    n = len(s)
    sa = np.empty(n, np.int32)
    if n == 1:
        sa[0] = 0
        return sa
    small = _types(s)
    is_lms = small.copy()
    is_lms[1:] &= ~small[:-1]
    is_lms[0] = False
    lms = np.flatnonzero(is_lms).astype(np.int32)
    edges = np.append(0, np.cumsum(np.bincount(s, minlength=letters)))
    if len(lms) > 1:
        _induce(s, small, lms, sa, edges)
        order = sa[is_lms[sa]]
        names, distinct = _names(s, lms, order)
        if distinct < len(lms):
            # The sentinel's own substring is last in the text and smallest, so the reduced string ends in a sentinel.
            order = lms[sais(names, distinct)]
        lms = order
    _induce(s, small, lms, sa, edges)
    return sa


def _extend(wide: np.ndarray, a: np.ndarray, b: np.ndarray, have: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes at a and b, at least have, counted up to cap or a little more."""
    out = have.copy()
    live = np.flatnonzero((out < cap) & (b >= 0))
    n = len(wide)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        diff = wide[x] ^ wide[y]
        whole = diff == 0
        low = diff & (~diff + np.uint64(1))
        same = np.zeros(len(live), np.int64)
        same[~whole] = np.log2(low[~whole].astype(np.float64)).astype(np.int64) // 8
        out[live] += np.where(whole, 8, same)
        live = live[whole]
        live = live[out[live] < cap]
    return out


def plcp(text: np.ndarray, sa: np.ndarray, cap: int, stride: int = 32) -> np.ndarray:
    """Permuted common prefixes, at least cap where they are: of each suffix of the bytes text with its predecessor in sa.

    A suffix shares with its predecessor at most one letter less than the suffix before
    it. So every stride-th value is computed in full, and bounds what lies between;
    only where the bounds leave open whether cap is reached are letters compared.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([text, np.arange(8, dtype=np.uint8)])
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]
    wide = np.ascontiguousarray(wide).view(np.uint64).ravel()
    at = np.arange(0, n, stride)
    long = cap + stride
    sample = _extend(wide, at, phi[at], np.zeros(len(at), np.int64), long)
    i = np.arange(n)
    low = np.maximum(0, np.repeat(sample, stride)[:n] - i % stride)
    after = np.append(sample[1:], 0)
    gap = stride - i % stride
    high = np.repeat(after, stride)[:n] + gap
    high[i // stride == len(sample) - 1] = n
    open_ = np.flatnonzero((low < cap) & (high >= cap) & (i % stride != 0))
    low[open_] = _extend(wide, open_, phi[open_], low[open_], cap)
    return np.minimum(low, n - i)


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """Whether the length bytes from each position occur elsewhere in text as well; byte 0xFF separates and is in no match."""
    n = len(text)
    coded = np.empty(n + 1, np.int16)
    # Separators sort after all letters of UTF-8, which has no byte 0xFF; the sentinel is 0.
    coded[:-1] = text.astype(np.int16) + 1
    coded[-1] = 0
    sa = sais(coded, 257)[1:]
    common = plcp(text, sa, length)
    yes = common >= length
    # A match with the predecessor is one with the successor seen from the other side.
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    hit = np.flatnonzero(yes)
    yes[before[hit]] = True
    # Strings that run over a separator are none.
    stops = np.flatnonzero(text == 0xFF)
    following = np.append(stops, n)[np.searchsorted(stops, np.arange(n))]
    return yes & (following - np.arange(n) >= length)
