"""Words of Arrow text batches as flat arrays: positions in the lower-cased bytes and 64-bit hashes.

A word is a maximal run of digits, ASCII letters and bytes over 0x7F (so any character outside ASCII), after A-Z are
lower-cased. Everything is vectorised over the bytes of a batch; memory is a small multiple of `BLOCK` beyond them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(2 * BLOCK, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    data: np.ndarray  #: lower-cased bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  #: the first word of each text, and the number of words
    hashes: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def words_of(texts: pa.Array) -> Words:
    raw, offsets = flat(texts)
    data = _LOWER[raw]
    inside = _IS_WORD[data]
    n = len(data)
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = True, True
    edge[1:n] = inside[1:] != inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    edge[cuts] = True
    at = np.flatnonzero(edge)
    if n == 0:
        starts = ends = np.zeros(0, np.int64)
    else:
        keep = inside[at[:-1]]
        starts, ends = at[:-1][keep], at[1:][keep]
    return Words(data, starts, ends, np.searchsorted(starts, offsets), _hash_words(data, starts, ends))


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, taken from differences of running sums, then mixed."""
    out = np.empty(len(starts), np.uint64)
    power, inverse = _powers()
    i = 0
    while i < len(starts):
        begin = int(starts[i])
        j = int(np.searchsorted(ends, begin + 2 * BLOCK, "right"))
        if j <= i:  # a single word longer than two blocks
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        stop = int(ends[j - 1])
        sums = np.empty(stop - begin + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data[begin:stop].astype(np.uint64) + np.uint64(1)) * power[: stop - begin], out=sums[1:])
        s, e = starts[i:j] - begin, ends[i:j] - begin
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s])
        i = j
    return out


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` word hashes (runs across texts included; the caller leaves those out)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out)
