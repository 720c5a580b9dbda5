"""Suffix arrays by induced sorting, and the permuted common prefixes of neighbours.

Suffixes are classified (S: smaller than the next suffix, L: larger); leftmost S suffixes (LMS) mark substrings that
are sorted by one round of induction, named, and, where names repeat, ordered by the same procedure on the string of
names. From the ordered LMS suffixes the rest is induced bucket by bucket. Byte strings are induced with whole buckets
at a time; the strings of names, whose alphabets are large, entry by entry.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type. The empty suffix after the end is the smallest, so the last one is L-type."""
    n = len(t)
    less = np.empty(n, np.int8)  # 1 smaller than the next symbol, 0 larger, 2 equal
    less[:-1] = np.where(t[:-1] < t[1:], 1, np.where(t[:-1] > t[1:], 0, 2))
    less[-1] = 0
    known = np.where(less != 2, np.arange(n), n)
    nxt = np.minimum.accumulate(known[::-1])[::-1]  # the next place that is decided by itself
    return less[nxt] == 1


def _append(bins: list[list[np.ndarray]], t: np.ndarray, at: np.ndarray) -> None:
    """Append positions to the bucket of their symbol, in order."""
    if len(at) == 0:
        return
    c = t[at]
    order = np.argsort(c, kind="stable")
    c, at = c[order], at[order]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    first = 0
    for cut in [*cuts.tolist(), len(c)]:
        bins[c[first]].append(at[first:cut])
        first = cut


def _induce_bytes(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray]:
    """(the suffix array, its S-type part in ascending order) induced from LMS suffixes in the given order."""
    n = len(t)
    start: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    _append(start, t, lms)
    low: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    low[t[n - 1]].append(np.array([n - 1]))
    done_low: list[np.ndarray] = []
    empty = np.zeros(0, np.int64)
    for c in range(sigma):
        mine, wave = [], np.concatenate(low[c]) if low[c] else empty
        while len(wave):
            mine.append(wave)
            before = wave[wave > 0] - 1
            before = before[~s[before]]
            same = t[before] == c
            _append(low, t, before[~same])
            wave = before[same]
        done_low.append(np.concatenate(mine) if mine else empty)
        for x in start[c]:
            before = x[x > 0] - 1
            _append(low, t, before[~s[before]])
    high: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    done_high: list[np.ndarray] = [empty] * sigma
    for c in range(sigma - 1, -1, -1):
        mine, wave = [], np.concatenate(high[c]) if high[c] else empty
        while len(wave):
            mine.append(wave)
            before = wave[wave > 0] - 1
            before = before[s[before]]
            same = t[before] == c
            _append(high, t, before[~same])
            wave = before[same]
        done_high[c] = np.concatenate(mine)[::-1] if mine else empty
        x = done_low[c][::-1]
        before = x[x > 0] - 1
        _append(high, t, before[s[before]])
    return np.concatenate([x for c in range(sigma) for x in (done_low[c], done_high[c])]), np.concatenate(done_high)


def _induce_names(t: list[int], s: list[bool], lms: list[int], sigma: int, sizes: list[int]) -> list[int]:
    n = len(t)
    sa = [-1] * n
    tails, total = [], 0
    for x in sizes:
        total += x
        tails.append(total)
    end = tails[:]
    for i in reversed(lms):
        c = t[i]
        end[c] -= 1
        sa[end[c]] = i
    head = [0, *tails[:-1]]
    c = t[n - 1]
    sa[head[c]] = n - 1
    head[c] += 1
    for j in range(n):
        i = sa[j] - 1
        if i >= 0 and not s[i]:
            c = t[i]
            sa[head[c]] = i
            head[c] += 1
    end = tails[:]
    for j in range(n - 1, -1, -1):
        i = sa[j] - 1
        if i >= 0 and s[i]:
            c = t[i]
            end[c] -= 1
            sa[end[c]] = i
    return sa


def _named(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of LMS substrings, in the order of the text; `ordered` has their places in sorted order."""
    n = len(t)
    length = np.append(np.diff(lms) + 1, n - lms[-1] + 1)  # the last one ends at the end of the text
    of = np.empty(n, np.int64)
    of[lms] = np.arange(len(lms))
    k = of[ordered]
    a, b = ordered[:-1], ordered[1:]
    same = (length[k[:-1]] == length[k[1:]]) & (b + length[k[1:]] <= n) & (a + length[k[:-1]] <= n)
    live, at = np.flatnonzero(same), 0
    while len(live):
        equal = t[a[live] + at] == t[b[live] + at]
        same[live[~equal]] = False
        at += 1
        live = live[equal]
        live = live[length[k[live]] > at]
    names = np.empty(len(lms), np.int64)
    names[k] = np.concatenate(([0], np.cumsum(~same)))
    return names


def suffix_array(t: np.ndarray, sigma: int | None = None) -> np.ndarray:
    """Starts of the suffixes of t (integers from 0) in lexicographic order."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    sigma = sigma or int(t.max()) + 1
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    few = sigma <= 512
    if few:
        sizes = flags = symbols = None
    else:
        sizes, flags, symbols = np.bincount(t, minlength=sigma).tolist(), s.tolist(), t.tolist()

    def induce(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if few:
            return _induce_bytes(t, s, order, sigma)
        sa = np.array(_induce_names(symbols, flags, order.tolist(), sigma, sizes))
        return sa, sa[s[sa]]

    if len(lms) > 1:
        _, rough = induce(lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = rough[is_lms[rough]]
        names = _named(t, lms, ordered)
        if int(names.max()) + 1 < len(lms):
            ordered = lms[suffix_array(names, int(names.max()) + 1)]
        return induce(ordered)[0]
    return induce(lms)[0]


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place p, the length (at most `most`) that the suffix at p has in common with the one before it in sa."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    words = np.zeros(n + most + 8, np.uint64)  # eight symbols from each place on
    padded = np.concatenate((t.astype(np.uint64) + np.uint64(1), np.zeros(most + 16, np.uint64))) & np.uint64(0xFF)
    for j in range(8):
        words |= padded[j : j + len(words)] << np.uint64(8 * j)
    live = np.flatnonzero(phi >= 0)
    for at in range(0, most, 8):
        differ = words[live + at] ^ words[phi[live] + at]
        out[live] = at + 8
        off = differ != 0
        low = differ[off] & (~differ[off] + np.uint64(1))
        out[live[off]] = at + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        live = live[~off]
    ends = np.minimum(n - np.arange(n), n - np.maximum(phi, 0))
    return np.minimum(np.minimum(out, most), np.where(phi >= 0, ends, 0))
