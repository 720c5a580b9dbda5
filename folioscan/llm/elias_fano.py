"""Elias-Fano code of a non-decreasing sequence, with select structures, and the segment format that uses it.

n values below u take n * (2 + log2(u / n)) bits or so: each value's low bits stand in an array, its high bits as a
one in a unary bit vector, at high + index. select1(i) finds the i-th one: a sampled directory gives the bit position
of every 256th one, and the rest is counted in the bytes after it. block(j) decodes the 256 values from one directory
entry to the next, so a scan holds 256 values at a time and never a table of them all.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
MAGIC = b"FSEG0002"
#: magic; documents and ids before the segment in its part; documents, ids and null doc_ids in it; the smallest doc_id; low bits of ends
#: and doc_ids, whether ids take 4 bytes; sizes of low, high and samples of ends, then of doc_ids
_HEAD = struct.Struct("<8sQQQQQqBBBx6I")


def encode(values: np.ndarray, universe: int) -> tuple[int, bytes, bytes, bytes]:
    """(low bits per value, low array, high bit vector, samples) of non-decreasing values in [0, universe]."""
    n = len(values)
    v = values.astype(np.uint64)
    width = max(0, int(universe // max(n, 1)).bit_length() - 1)
    low = v & np.uint64((1 << width) - 1)
    bits = ((low[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if width else np.zeros((n, 0), np.uint8)
    ones = ((v >> np.uint64(width)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
    high = np.zeros(int(universe >> width) + n + 1, np.uint8)
    high[ones] = 1
    return width, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes()


class Sequence:
    """Random access to an encoded sequence."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width = n, width
        self.low, self.high, self.samples = low, np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u4")

    def select(self, i: int) -> int:
        """Bit position of the i-th one (from 0)."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        window = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        window[: at & 7] = 0
        while True:
            ones = int(window.sum())
            if left < ones:
                return byte * 8 + int(np.flatnonzero(window)[left])
            left -= ones
            byte += len(window) >> 3
            window = np.unpackbits(self.high[byte : byte + 64], bitorder="little")

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        low, first = 0, i * self.width
        if self.width:
            raw = int.from_bytes(self.low[first >> 3 : (first + self.width + 7) >> 3], "little")
            low = raw >> (first & 7) & ((1 << self.width) - 1)
        return ((self.select(i) - i) << self.width) | low

    def block(self, j: int) -> np.ndarray:
        """Values j * SAMPLE up to the next block's, as unsigned 64-bit integers."""
        first, last = j * SAMPLE, min(self.n, (j + 1) * SAMPLE)
        start = int(self.samples[j])
        stop = int(self.samples[j + 1]) if j + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :]
        ones = np.flatnonzero(bits)[: last - first] + start
        values = (ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.width)
        if self.width:  # SAMPLE values take a whole number of bytes
            raw = np.frombuffer(self.low, np.uint8)[first * self.width >> 3 : (last * self.width + 7) >> 3]
            low = np.unpackbits(raw, bitorder="little")[: (last - first) * self.width].reshape(-1, self.width).astype(np.uint64)
            values |= (low << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return values

    def __iter__(self):
        for j in range(-(-self.n // SAMPLE)):
            yield from self.block(j).tolist()


def write_segment(ordinal: int, start: int, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: header, Elias-Fano codes of the documents' ends and of their doc_ids (nulls first, then ascending), and the ids in 2 bytes (4 if any needs them)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    keys = np.array([k for k in doc_ids if k is not None], np.int64)
    base = int(keys[0]) if len(keys) else 0
    width, *offsets = encode(ends, total)
    key_width, *numbers = encode(keys.view(np.uint64) - np.uint64(base & (1 << 64) - 1), int(keys[-1]) - base if len(keys) else 0)
    wide = bool(len(ids)) and int(ids.max()) >= 1 << 16
    head = _HEAD.pack(MAGIC, ordinal, start, len(doc_ids), total, len(doc_ids) - len(keys), base, width, key_width, wide, *map(len, (*offsets, *numbers)))
    return b"".join((head, *offsets, *numbers, ids.astype("<u4" if wide else "<u2").tobytes()))


class Segment:
    """A segment read back: single offsets and doc_ids by select (span, doc_id), all of them in order by spans, a block at a time."""

    def __init__(self, image: bytes):
        magic, self.ordinal, self.start, self.n, self.total, self.nulls, self.base, width, key_width, wide, *sizes = _HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        parts, at = [], _HEAD.size
        for size in sizes:
            parts.append(bytes(image[at : at + size]))
            at += size
        self.ends = Sequence(self.n, width, *parts[:3])
        self.keys = Sequence(self.n - self.nulls, key_width, *parts[3:])
        self.ids = np.frombuffer(image, "<u4" if wide else "<u2", offset=at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.keys[i - self.nulls]

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def spans(self):
        """(doc_id, begin, end) of every document."""
        begin, keys = 0, iter(self.keys)
        for i, end in enumerate(self.ends):
            yield (None if i < self.nulls else self.base + next(keys)), begin, end
            begin = end

    def __getitem__(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.ids[a:b]
