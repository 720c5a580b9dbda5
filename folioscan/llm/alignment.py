"""Two tokenizers over the same texts: groups of ids that end at the same bytes, links by overlap, corpus-wide counts.

The unit of work is the group dictionary. A text falls into groups (the ids of both sides between two places where
tokens of both end); groups repeat, so every block of texts interns its distinct groups, and only the dictionaries
travel: (block, number, key) rows and, summed over blocks, how many documents hold a pair of ids linked. The links of a
distinct group are expanded once, weighed with the counts of their pairs, and what comes out goes back to the blocks by
the group's key, where it is multiplied by how often each document has the group. Documents keep (number, times)
vectors; no row is made for an occurrence, and a block is bounded by BLOCK bytes of text (a single longer text aside).

Encoding. A space and a text are cut into units where both vocabularies must end a token: before a space or a line feed
that follows a character that isn't white space, and behind a line feed between two such characters. (The first side's
splitting pattern never joins white space to what stands before it; of the second side's pieces none has a mark of a
space behind another character, and none has a line feed, which is checked.) Every distinct unit is encoded and aligned once in a
worker's memory; a vocabulary that fails the check gets whole texts.

Defined results. Null and empty texts, and texts whose joined tokens differ from the space and the text in bytes (such
as texts with U+2581): no tokens, zeros, an empty digest. Texts of any length are encoded whole. Repeated rows, equal
doc_ids and null doc_ids: each row is a document of its own, in the counts too. Ties for the best count: all count as
best. Empty table: no rows. Columns beside doc_id and text: ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import pick, stage
from folioscan.llm.tokens import slices, text_sizes

#: Bytes of text in a block, units and their characters remembered by a worker, characters of a unit worth remembering.
BLOCK, UNITS, HELD, LONG = 8_000_000, 400_000, 16_000_000, 100
#: Fixed value: the mark of a space in the pieces of the second side.
MARK = "▁"
#: One match a unit, none left out.
_UNIT = re.compile(r"\n(?=\S)|\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")


def _byte_level() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ragged:
    """Numbered sequences of integers, one after the other in one array."""

    def __init__(self, dtype):
        self.flat, self.start, self.used, self.n = np.empty(1 << 14, dtype), np.zeros(1 << 12, np.int64), 0, 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(values) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.n + len(counts) >= len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
        self.flat[self.used : self.used + len(values)] = values
        self.start[self.n + 1 : self.n + 1 + len(counts)] = self.used + np.cumsum(counts)
        self.used, self.n = self.used + len(values), self.n + len(counts)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the sequences of these numbers in a row, their lengths)."""
        counts = self.start[numbers + 1] - self.start[numbers]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.start[numbers] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], counts


class Pair:
    """Two tokenizers; what one unit of text comes to on both sides."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(first), SentencePieceProcessor(model_file=second)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        if hasattr(self.a.model, "_resize_cache"):
            self.a.model._resize_cache(0)  # units come once
        of, vocab = _byte_level(), self.a.get_vocab()
        self.a_bytes = np.ones(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.a_bytes[i] = len(token) if all(c in of for c in token) else len(token.encode())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.b_bytes = np.array([len(p) for p in self.pieces], np.int64)
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.cuts = not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain)
        self.space = [i for i, p in enumerate(pieces) if p == MARK]
        self.lead = self.b.encode("\n")
        self.forget()

    def forget(self) -> None:
        self.number, self.groups, self.keys, self.said, self.held = {}, {}, [], [], 0
        self.sizes = np.zeros((0, 3), np.int64)  # ids on either side, groups; -1 where the bytes differ
        self.unit_groups, self.links = Ragged(np.int64), Ragged(np.int64)

    def units(self, text: str) -> list[str]:
        return _UNIT.findall(" " + text) if self.cuts else [" " + text]

    def _second(self, units: list[str]) -> list[list[int]]:
        """Ids of units inside a text. The library puts a space before what it gets; a line feed keeps that apart."""
        led = [u[0] == " " and len(u) > 1 for u in units]
        ids = self.b.encode([u[1:] if x else "\n" + u for u, x in zip(units, led, strict=True)], num_threads=1)
        skip = len(self.lead)
        return [x if y else self.space if u == " " else x[skip:] for u, x, y in zip(units, ids, led, strict=True)]

    def learn(self, units: list[str]) -> None:
        """Encode and align distinct units that aren't known yet; the i-th gets the next number but i."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self._second(units)
        same = [b"".join([self.pieces[i] for i in y]) == u.encode() for u, y in zip(units, b, strict=True)]
        a, b = [x if s else [] for x, s in zip(a, same, strict=True)], [y if s else [] for y, s in zip(b, same, strict=True)]
        flat_a, flat_b = (np.fromiter((i for x in side for i in x), np.int64, sum(map(len, side))) for side in (a, b))
        bounds = align(self.a_bytes[flat_a], self.b_bytes[flat_b])
        pairs = flat_a[bounds.link_a] << 32 | flat_b[bounds.link_b]
        keys, n_groups = self._keys(flat_a, flat_b, bounds), np.zeros(len(units), np.int64)
        na = np.fromiter(map(len, a), np.int64, len(a))
        if len(flat_a):  # the group in which a unit's last token ends
            ends = np.cumsum(na)
            n_groups = np.diff(np.where(ends > 0, bounds.group_a[np.maximum(ends, 1) - 1] + 1, 0), prepend=0)
        fresh, numbers = [], np.empty(len(keys), np.int64)
        for g, key in enumerate(keys):
            n = self.groups.get(key)
            if n is None:
                n = self.groups[key] = len(self.keys)
                self.keys.append(key)
                fresh.append(g)
            numbers[g] = n
        starts = np.searchsorted(bounds.link_group, np.arange(len(keys) + 1))
        new = np.array(fresh, np.int64)
        counts = starts[new + 1] - starts[new]
        self.links.add(pairs[np.repeat(starts[new] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())], counts)
        self.unit_groups.add(numbers, n_groups)
        nb = np.fromiter(map(len, b), np.int64, len(b))
        sizes = np.stack((na, nb, np.where(same, n_groups, -1)), 1)
        self.sizes = np.concatenate((self.sizes, sizes))
        at = 0
        for n in n_groups.tolist():
            self.said.append(";".join(keys[at : at + n]))
            at += n

    @staticmethod
    def _keys(flat_a: np.ndarray, flat_b: np.ndarray, bounds: Bounds) -> list[str]:
        sides = []
        for flat, group in ((flat_a, bounds.group_a), (flat_b, bounds.group_b)):
            text, at, out = list(map(str, flat.tolist())), 0, []
            for n in np.bincount(group, minlength=bounds.n).tolist():
                out.append(text[at] if n == 1 else ",".join(text[at : at + n]))
                at += n
            sides.append(out)
        return [f"{x}|{y}" for x, y in zip(*sides, strict=True)]

    def expand(self, key: str) -> list[tuple[int, int]]:
        """The links of a group, from its key."""
        a, b = (np.array(x.split(","), np.int64) for x in key.split("|"))
        bounds = align(self.a_bytes[a], self.b_bytes[b])
        return list(zip(a[bounds.link_a].tolist(), b[bounds.link_b].tolist(), strict=True))

    def block(self, texts: list[str | None]) -> tuple[dict[str, list], list[str], np.ndarray, np.ndarray]:
        """(columns of the documents, the block's group keys, its linked pairs, documents that have each)."""
        if len(self.said) > UNITS or self.held > HELD:
            self.forget()
        known, cut, fresh, once = self.number, [], {}, {}
        for t in texts:
            u = self.units(t) if t else []
            cut.append(u)
            for x in u:
                if x not in known:
                    (fresh if len(x) <= LONG else once)[x] = None
        base = len(self.said)
        for some in (fresh, once):  # long units are aligned too, but not remembered
            for x in some:
                known[x] = base
                base += 1
        new = [*fresh, *once]
        self.held += sum(map(len, new))
        for lo, hi in slices([len(x) for x in new], 2_000_000):
            self.learn(new[lo:hi])
        flat = np.fromiter((known[x] for u in cut for x in u), np.int64, sum(map(len, cut)))
        doc = np.repeat(np.arange(len(cut)), [len(u) for u in cut])
        for x in once:
            del known[x]
        bad = np.zeros(len(cut), bool)
        bad[doc[self.sizes[flat, 2] < 0]] = True
        keep = ~bad[doc]
        flat, doc = flat[keep], doc[keep]
        totals = np.zeros((len(cut), 3), np.int64)
        for k in range(3):
            totals[:, k] = np.bincount(doc, self.sizes[flat, k], len(cut)).astype(np.int64)
        digests, at = [], 0
        for n in np.bincount(doc, minlength=len(cut)).tolist():
            digests.append(hashlib.sha256(";".join([self.said[i] for i in flat[at : at + n].tolist()]).encode()).hexdigest() if n else "")
            at += n
        doc, unit, times = _counted(doc, flat, len(self.said))
        group, sizes = self.unit_groups.take(unit)
        doc, group, times = _counted(np.repeat(doc, sizes), group, len(self.keys), np.repeat(times, sizes))
        mine, local = np.unique(group, return_inverse=True)
        pairs, sizes = self.links.take(mine)
        pairs, numbered = np.unique(pairs, return_inverse=True)
        of = Ragged(np.int64)
        of.add(numbered, sizes)
        linked, sizes = of.take(local)
        _, linked, _ = _counted(np.repeat(doc, sizes), linked, len(pairs))
        columns = {"n_a": totals[:, 0], "n_b": totals[:, 1], "n_groups": totals[:, 2], "groups_sha256": digests}
        ends = np.cumsum(np.bincount(doc, minlength=len(cut)))
        offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
        columns |= {"grp": pa.ListArray.from_arrays(offsets, pa.array(local, pa.int32())), "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))}
        return columns, [self.keys[i] for i in mine.tolist()], pairs, np.bincount(linked, minlength=len(pairs))


class Bounds:
    """Of two rows of tokens over the same bytes: the group of each token, and the links in order."""

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray):
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        both = np.union1d(ends_a, ends_b)  # between two ends lies exactly one overlap of two tokens
        self.n = len(common)
        self.group_a, self.group_b, self.link_group = (np.searchsorted(common, x) for x in (ends_a, ends_b, both))
        self.link_a, self.link_b = np.searchsorted(ends_a, both), np.searchsorted(ends_b, both)


def align(bytes_a: np.ndarray, bytes_b: np.ndarray) -> Bounds:
    return Bounds(np.cumsum(bytes_a), np.cumsum(bytes_b))


def _counted(doc: np.ndarray, item: np.ndarray, n: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, item), ascending, with the sum of their times (default: 1 each)."""
    key = doc * max(1, n) + item
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.diff(np.append(first, len(key))) if times is None else np.add.reduceat(times[order], first) if len(first) else times[:0]
    return key[first] // max(1, n), key[first] % max(1, n), total


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(first: str, second: str) -> Pair:
    """One pair per worker and files."""
    if (first, second) not in _PAIRS:
        _PAIRS[first, second] = Pair(first, second)
    return _PAIRS[first, second]


_STAGED = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, grp array<int>, times array<int>, number int, key string, pair long, n_docs long"


def _encode(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of three kinds: documents (grp set), a block's groups (key set), its pairs with their documents (pair set)."""
    schema = pa.schema(
        [(n, pa.int64()) for n in ("block", "doc_id", "n_a", "n_b", "n_groups")]
        + [("groups_sha256", pa.string()), ("grp", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("number", pa.int32()), ("key", pa.string()), ("pair", pa.int64()), ("n_docs", pa.int64())]
    )

    def rows(n: int, **columns) -> pa.RecordBatch:
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array) else columns.get(f.name, pa.nulls(n, f.type)) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, both = TaskContext.get().partitionId() << 32, pair(first, second)
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, held, size
            ids, texts = (pa.concat_arrays([x[k] for x in held]) for k in (0, 1))
            columns, keys, pairs, n_docs = both.block(texts.to_pylist())
            held, size = [], 0
            yield rows(len(ids), block=np.full(len(ids), block), doc_id=ids, **columns)
            if keys:
                yield rows(len(keys), block=np.full(len(keys), block), number=np.arange(len(keys)), key=keys)
                yield rows(len(pairs), pair=pairs, n_docs=n_docs)
            block += 1

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = text_sizes(texts)
            for lo, hi in slices(sizes, BLOCK):
                some = sum(sizes[lo:hi])
                if held and size + some > BLOCK:
                    yield from flush()
                held.append((ids.slice(lo, hi - lo), texts.slice(lo, hi - lo)))
                size += some
        if held:
            yield from flush()

    return pick(docs, "doc_id", "text").mapInArrow(work, _STAGED)


def group_table(staged: DataFrame, first: str, second: str) -> DataFrame:
    """key, n_best, count_sum of every distinct group: its links that are the best of their first id, and the counts of its links.

    Links are expanded once per distinct group. The highest counts are broadcast: a row per id of the first vocabulary.
    """
    counts = staged.filter("pair is not null").groupBy("pair").agg(F.sum("n_docs").alias("count"))
    counts = stage(counts, "pair-counts")
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    judged = counts.withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("is_best"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(first, second)
        for batch in batches:
            keys, pairs = [], []
            for key in batch.column(0).to_pylist():
                links = both.expand(key)
                keys += [key] * len(links)
                pairs += [a << 32 | b for a, b in links]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(pairs, pa.int64())], names=["key", "pair"])

    links = staged.filter("key is not null").select("key").distinct().mapInArrow(work, "key string, pair long")
    return links.join(judged, "pair").groupBy("key").agg(F.sum("is_best").alias("n_best"), F.sum("count").alias("count_sum"))


def pair_counts(docs: DataFrame, first: str, second: str) -> DataFrame:
    """a, b, n_docs: how many documents hold these ids linked."""
    found = _encode(docs, first, second).filter("pair is not null").groupBy("pair").agg(F.sum("n_docs").alias("n_docs"))
    return found.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "n_docs")


def align_documents(docs: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    staged = stage(_encode(docs, first, second), "aligned")
    groups = staged.filter("key is not null").select("block", "number", "key").join(group_table(staged, first, second), "key").select(F.col("block").alias("of"), "number", "n_best", "count_sum")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "grp", "times"]
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        """The block's results by number, times how often a document has each group."""
        values = np.zeros((2, len(right)), np.int64)
        for k, name in enumerate(("n_best", "count_sum")):
            values[k, right.column("number").to_numpy()] = right.column(name).to_numpy()
        grp, times = left.column("grp").combine_chunks(), left.column("times").combine_chunks()
        ends = np.cumsum(pc.list_value_length(grp).to_numpy(zero_copy_only=False).astype(np.int64))
        number, n = grp.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        sums = [np.concatenate(([0], np.cumsum(v[number] * n)))[np.concatenate(([0], ends))] for v in values]
        size = [left.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b", "n_groups")]
        columns = [left.column("doc_id"), *size, size[0] + size[1] - size[2], *map(np.diff, sums), left.column("groups_sha256")]
        return pa.table(dict(zip([x.split()[0] for x in out.split(", ")], columns, strict=True)))

    rows = staged.filter("grp is not null").select("block", *kept)
    return rows.groupBy("block").cogroup(groups.groupBy("of")).applyInArrow(back, out)
