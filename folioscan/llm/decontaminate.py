"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is the set of its windows of `window` words (an item of fewer words: one window of them all), a
window the set of its shingles of five words (of all its words where it has fewer). Shingles are ordered by rarity,
their frequency over all documents. As a window must be contained whole, the prefix that any containing document must
meet is one token long: the window's rarest shingle. Documents' shingles are joined with these prefixes; the place of
the shingle in its window bounds where the window starts, and start and length must lie inside the document; what
passes is verified word by word.

The benchmark is taken in blocks of at most BLOCK_BYTES of text (or one item, if that is longer), whose indexes are
broadcast one at a time, so its size is not bounded by memory: each block is a pass over the documents, and a
document's passes are merged. An index is flat arrays over the block's words, at most INDEX_BYTES for each byte of text,
which is checked before it is broadcast. A benchmark of one block (the common case) needs no shuffle of documents; each
further block costs one more scan of them, and with several blocks the documents' counts and hits shuffle once.

Defined results. Null or empty text, text without words: 0 words, not contaminated; as an item: no windows. Repeated
items and rows: each counts. Null item_id: its windows hit, it isn't listed. Texts of any length are read whole.
Empty tables: no rows, or no hits. Extra columns: ignored by `report`, kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import ordinals, pick, stage
from folioscan.llm.tokens import slices, text_sizes
from folioscan.llm.words import Words, shingles, words_of

WINDOW, SHINGLE = 10, 5
BLOCK_BYTES, INDEX_BYTES = 4 << 20, 64
CHUNK = 2_000_000
_FILTER_BITS = 20


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first place, number) of equal rows: the place where each distinct row comes first, and each row's number."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order, number


class Index:
    """The distinct windows of a block of items as places in its words, and the prefix shingle of each.

    words: the block's words. start, size: of each window, in words. first, items: the item numbers of window k are
    items[first[k] : first[k + 1]], names their texts. prefix: for each shingle size in use the sorted prefix shingles
    with the window and the shingle's place in it.
    """

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int = WINDOW, shingle: int = SHINGLE):
        self.shingle = shingle
        self.words = w = words_of(pa.array([t for _, t in rows], pa.string()))
        n = np.diff(w.first)
        sizes = np.minimum(n, window)
        count = np.where(n > 0, n - sizes + 1, 0)
        item = np.repeat(np.arange(len(rows)), count)
        start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(w.first[:-1], count)
        size = sizes[item]
        columns = [size]
        for j in range(int(size.max()) if len(size) else 0):  # windows are equal if all their words are: their hashes, and below their bytes
            columns.append(np.where(j < size, w.hashes[np.minimum(start + j, len(w.hashes) - 1)], np.uint64(0)))
        at, number = _distinct(columns)
        if len(at):  # two words of one hash: such windows stay apart
            other = np.flatnonzero(at[number] != np.arange(len(number)))
            unlike = [i for i in other.tolist() if self._bytes(start[i], size[i]) != self._bytes(start[at[number[i]]], size[i])]
            number[unlike] = len(at) + np.arange(len(unlike))
            at = np.concatenate((at, np.array(unlike, np.int64)))
        self.start, self.size = start[at].astype(np.int32), size[at].astype(np.uint8)
        names: dict[str, int] = {}
        named = np.array([-1 if k is None else names.setdefault(k, len(names)) for k, _ in rows], np.int64)[item]
        pair = np.unique(np.stack([number, named], axis=1)[named >= 0], axis=0)
        self.names, self.items = list(names), pair[:, 1].astype(np.int32)
        self.first = np.searchsorted(pair[:, 0], np.arange(len(at) + 1)).astype(np.int32)

    def _bytes(self, start: int, size: int) -> bytes:
        w = self.words
        return b"\0".join(w.word(i) for i in range(int(start), int(start) + int(size)))

    def grams(self) -> dict[int, np.ndarray]:
        """The distinct shingles of all windows, ascending, by shingle size."""
        return {k: np.unique(np.concatenate([g for _, _, g in some])) for k, some in self._shingles().items()}

    def _shingles(self) -> dict[int, list[tuple[np.ndarray, int, np.ndarray]]]:
        """By shingle size: (windows, place, hash) of each place of a shingle in its window."""
        out: dict[int, list] = {}
        for size in np.unique(self.size).tolist():
            k, some = min(self.shingle, size), np.flatnonzero(self.size == size)
            h = shingles(self.words.hashes, k)
            for place in range(size - k + 1):
                out.setdefault(k, []).append((some, place, h[self.start[some] + place]))
        return out

    def rank(self, frequency: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> Index:
        """Choose each window's prefix: its rarest shingle; of equal ones the smaller hash, then the earlier place."""
        self.prefix = {}
        for k, some in self._shingles().items():
            window = np.concatenate([v for v, _, _ in some])
            place = np.concatenate([np.full(len(v), p, np.uint8) for v, p, _ in some])
            gram = np.concatenate([g for _, _, g in some])
            n = np.zeros(len(gram), np.int64)
            if frequency and len(frequency[k][0]):
                known, times = frequency[k]
                i = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                n = np.where(known[i] == gram, times[i], 0)
            order = np.lexsort((place, gram, n, window))
            best = order[np.concatenate(([True], window[order][1:] != window[order][:-1]))]
            best = best[np.argsort(gram[best], kind="stable")]
            passes = np.zeros(1 << _FILTER_BITS, bool)
            passes[gram[best] >> np.uint64(64 - _FILTER_BITS)] = True
            self.prefix[k] = gram[best], window[best].astype(np.int32), place[best], passes
        return self

    def nbytes(self) -> int:
        w = self.words
        flat = (w.data, w.starts, w.ends, w.first, w.hashes, self.start, self.size, self.first, self.items)
        return sum(x.nbytes for x in flat) + sum(x.nbytes for p in self.prefix.values() for x in p[:3]) + sum(len(x) + 64 for x in self.names)

    def matches(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, window) of every verified occurrence."""
        found, mine = [(np.zeros(0, np.int64),) * 3], self.words
        for size, (gram, window, place, passes) in self.prefix.items():
            h = shingles(w.hashes, size)
            at = np.flatnonzero(passes[h >> np.uint64(64 - _FILTER_BITS)])
            low, high = np.searchsorted(gram, h[at], "left"), np.searchsorted(gram, h[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            entry = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else low
            k = window[entry]
            start, length = np.repeat(at, n) - place[entry].astype(np.int64), self.size[k].astype(np.int64)
            doc = np.searchsorted(w.first, np.repeat(at, n), "right") - 1
            ok = (start >= w.first[doc]) & (start + length <= w.first[doc + 1])  # positional and length bounds
            start, k, doc, length = start[ok], k[ok], doc[ok], length[ok]
            for j in range(int(length.max()) if len(length) else 0):
                ok = (j >= length) | (w.hashes[np.minimum(start + j, len(w.hashes) - 1)] == mine.hashes[np.minimum(self.start[k] + j, len(mine.hashes) - 1)])
                start, k, doc, length = start[ok], k[ok], doc[ok], length[ok]
            exact = [all(w.word(s + j) == mine.word(b + j) for j in range(m)) for s, b, m in zip(start.tolist(), self.start[k].tolist(), length.tolist(), strict=True)]
            ok = np.array(exact, bool)
            found.append((doc[ok], start[ok], k[ok].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def items_of(self, k: int) -> list[str]:
        return [self.names[i] for i in self.items[self.first[k] : self.first[k + 1]].tolist()]


def _covered(w: Words, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each text, the words inside any of the spans."""
    steps = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + length, -1)
    total = np.concatenate(([0], np.cumsum(np.cumsum(steps[:-1]) > 0)))
    return total[w.first[1:]] - total[w.first[:-1]]


def _frequencies(docs: DataFrame, grams: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By shingle size: (shingles, occurrences over all documents) of those that occur. What reaches the driver is bounded by the block."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(v), np.int64) for k, v in shared.value.items()}
        passes = {}
        for k, v in shared.value.items():
            passes[k] = np.zeros(1 << _FILTER_BITS, bool)
            passes[k][v >> np.uint64(64 - _FILTER_BITS)] = True
        for batch in batches:
            for a, b in slices(text_sizes(batch.column(0)), CHUNK):
                w = words_of(batch.column(0).slice(a, b - a))
                for k, v in shared.value.items():
                    h = shingles(w.hashes, k)
                    h = h[passes[k][h >> np.uint64(64 - _FILTER_BITS)]]
                    i = np.minimum(np.searchsorted(v, h), len(v) - 1)
                    totals[k] += np.bincount(i[v[i] == h], minlength=len(v))
        for k, v in shared.value.items():
            some = totals[k] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), k, np.int32)), pa.array(v[some].view(np.int64)), pa.array(totals[k][some])], names=["size", "gram", "n"])

    found = pick(docs, "text").mapInArrow(count, "size int, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n")).toArrow()
    size, gram, n = (np.array(found.column(c)) for c in ("size", "gram", "n"))
    out = {}
    for k in grams:
        mine = gram[size == k].astype(np.int64).view(np.uint64)
        order = np.argsort(mine)
        out[k] = mine[order], n[size == k][order]
    return out


def indexes(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> Iterator[Index]:
    """One index a block of the benchmark: distinct items in order of a hash, cut at BLOCK_BYTES of running size."""
    items = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    weight = (F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 32).cast("long")
    items = items.withColumns({"_w": weight, "_h": F.xxhash64("item_id", "text")})
    size = items.agg(F.sum("_w")).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    if n > 1:
        items = stage(ordinals(items, ["_h", "item_id", "text"], {"_w": "before"}), "benchmark")
    for k in range(n):
        block = items if n == 1 else items.filter(F.floor(F.col("before") / BLOCK_BYTES) == k)
        rows = [(r.item_id, r.text) for r in block.select("item_id", "text").collect()]  # BLOCK_BYTES and one item at most
        index = Index(rows, window, shingle)
        if len(index.start) or k == 0:
            index.rank(_frequencies(docs, index.grams()) if len(index.start) else None)
            text = sum(len((t or "").encode()) + len((i or "").encode()) + 32 for i, t in rows)
            if index.nbytes() > INDEX_BYTES * text + (1 << 16):
                raise ValueError(f"index of {index.nbytes()} bytes over {text} bytes of text")
            yield index


_FIELDS = [("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))]


def _scan(docs: DataFrame, index: Index, spans: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for a, b in slices(text_sizes(batch.column(1)), CHUNK):
                w = words_of(batch.column(1).slice(a, b - a))
                doc, start, k = ix.matches(w)
                items: list[set] = [set() for _ in range(b - a)]
                runs: list[list[int]] = [[] for _ in range(b - a)]
                for d, s, v in zip(doc.tolist(), start.tolist(), k.tolist(), strict=True):
                    items[d].update(ix.items_of(v))
                    if spans:
                        runs[d] += (s - int(w.first[d]), s - int(w.first[d]) + int(ix.size[v]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(w.first)), pa.array(runs, pa.list_(pa.int64())), pa.array(_covered(w, start, ix.size[k].astype(np.int64))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    schema=pa.schema(_FIELDS),
                )

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row")).mapInArrow(scan, "doc_id long, row long, n_words long, spans array<long>, n_hit long, items array<string>")


def _merge(parts: list[DataFrame]) -> DataFrame:
    """Passes over several blocks: spans and items of equal rows together. Only documents' counts and hits shuffle."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for run in batch.column(batch.schema.get_field_index("spans")).to_pylist():
                n = last = 0
                for a, b in sorted(zip(run[::2], run[1::2], strict=True)):
                    n += max(0, b - max(a, last))
                    last = max(last, b)
                hit.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array(hit, pa.int64())], names=["doc_id", "n_words", "items", "n_hit"])

    merged = every.groupBy("doc_id", "row", "n_words").agg((F.count("*") / len(parts)).cast("int").alias("copies"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = merged.select("doc_id", "n_words", "items", "spans", F.explode(F.sequence(F.lit(1), "copies")).alias("_c")).drop("_c")
    return rows.mapInArrow(union, "doc_id long, n_words long, items array<string>, n_hit long")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), contaminated."""
    parts = list(indexes(docs, benchmark, window, shingle))
    found = _scan(docs, parts[0], False) if len(parts) == 1 else _merge([_scan(docs, p, True) for p in parts])
    return found.select("doc_id", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The documents without any benchmark window, with all their columns; one filtering pass a block, no shuffle."""
    # columns go by position, so names may repeat in any letter case
    left, at = docs.toDF(*[f"__fs_{i}" for i in range(len(docs.columns))]), docs.columns.index("text")
    schema = left.schema
    for index in indexes(docs, benchmark, window, shingle):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(text_sizes(batch.column(at)), CHUNK):
                    doc, _, _ = shared.value.matches(words_of(batch.column(at).slice(a, b - a)))
                    pure = np.ones(b - a, bool)
                    pure[doc] = False
                    yield batch.slice(a, b - a).filter(pa.array(pure))

        left = left.mapInArrow(keep, schema)
    return left.toDF(*docs.columns)
