"""Exact substring dedup over suffix arrays built by induced sorting.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Documents are
dealt into blocks by a hash. Each string of LENGTH bytes has a fingerprint, the smallest hash of the GRAM-byte strings
inside it, mixed again, so equal strings have equal fingerprints, and neighbouring strings mostly share theirs: the maximal run of
strings with one fingerprint is a piece.

1. Each block sends its distinct fingerprints to their owners, which send back those that two documents have.
2. Each block cuts the pieces with such fingerprints out of its documents, once per distinct piece, for the smallest
   doc_id in the block that has it (what larger doc_ids of the block repeat is marked at once), and sends them to shards
   by fingerprint. A piece whose fingerprint is crowded is cut into its single strings, dealt by their own hash, so
   that a passage in much of the corpus meets itself in many shards; blocks have aggregated it before it travels.
3. Each shard joins its distinct pieces into one text, sorts its suffixes by induction, computes the permuted common
   prefixes, and takes the smallest doc_id of each run of suffixes that agree in LENGTH bytes; strings
   that occur once there (their hash tells) stay out of the text. Strings whose smallest
   doc_id is smaller than the sender's are marked.
4. Each block removes the marked spans from its documents.

Documents shuffle once (the exchange is reused by steps 1, 2 and 4). Fingerprints only choose what is compared: marks
come from comparing the bytes themselves. Blocks are as many as the bytes of the texts ask for,
owners and shards as many as blocks.

Defined results. Null text: as the empty text. Documents shorter than LENGTH: kept whole. Equal doc_ids: as one
document, they don't mark each other. Null doc_id: smaller than all others. Very long texts: read whole. Empty table:
no rows. Extra columns: ignored by `cut_repeats`.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import pick
from folioscan.llm.suffix_array import permuted_common_prefixes, suffix_array
from folioscan.llm.words import flat, mix

LENGTH, GRAM = 50, 20
#: Documents (about) from which on a fingerprint is crowded.
CROWDED = 1 << 14
#: Bytes of text in a block (each row counts ROW more); pieces of a shard are dealt into PARTS, and sorted about SORTED bytes at a time.
BLOCK, ROW, PARTS, SORTED = 1 << 23, 64, 256, 1 << 20
SEPARATOR = 255  # no byte of UTF-8
_NULL = -(1 << 63)
_STEP = 1 << 19
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x27D4EB2F165667C5, 0xA0761D6478BD642F)]
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD[0])


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings (20 = 16 + 4), by doubling."""
    h = _BYTE[b]
    h = h[:-1] * _ODD[1] + h[1:]
    h4 = h[:-2] * _ODD[2] + h[2:]
    h = h4[:-4] * _ODD[3] + h4[4:]
    h = h[:-8] * _ODD[4] + h[8:]
    n = len(h) - 4
    return mix(h[:n] * _ODD[5] + h4[16 : 16 + n])


def _slices(b: np.ndarray):
    """(place, fingerprints of the strings of LENGTH bytes from there on), slice by slice."""
    n, width = len(b) - LENGTH + 1, LENGTH - GRAM + 1
    for lo in range(0, n, _STEP):
        hi = min(n, lo + _STEP)
        g = _gram_hashes(b[lo : hi + LENGTH - 1])
        reach = 1
        while 2 * reach <= width:
            g = np.minimum(g[:-reach], g[reach:])
            reach *= 2
        yield lo, mix(np.minimum(g[: hi - lo], g[width - reach : width - reach + hi - lo]))  # minima lie low: spread them


def fingerprints(b: np.ndarray) -> np.ndarray:
    """The fingerprint of each string of LENGTH bytes of b."""
    return np.concatenate([np.zeros(0, np.uint64), *(f for _, f in _slices(b))])


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first string, last string, fingerprint) of every piece; strings inside one document only."""
    count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    start = offsets[:-1][count > 0]
    stop = start + count[count > 0]
    firsts, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    before = None  # the fingerprint of the string before the slice, if that is inside a document
    for lo, f in _slices(data):
        a, b = np.searchsorted(stop, lo, "right"), np.searchsorted(start, lo + len(f), "left")
        inside = np.zeros(len(f) + 1, np.int8)
        inside[np.maximum(start[a:b] - lo, 0)] += 1  # documents are LENGTH - 1 or more apart here: no place is met twice
        inside[np.minimum(stop[a:b] - lo, len(f))] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (f[1:] != f[:-1])
        new[0] &= before is None or f[0] != before
        before = f[-1] if inside[-1] else None
        at = np.flatnonzero(new)
        firsts.append(at + lo)
        prints.append(f[at])
    first, f = np.concatenate(firsts), np.concatenate(prints)
    doc = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(data))[: len(first)], offsets[doc] + count[doc]) - 1
    return doc, first, last, f


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, bytes, offsets) of a block, documents in ascending order of doc_id and text; null doc_ids are the smallest."""
    table = table.set_column(table.schema.get_field_index("doc_id"), "doc_id", pc.fill_null(table.column("doc_id"), _NULL))
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    keys = table.column("doc_id").to_numpy().astype(np.int64)
    return keys, *flat(table.column("text"))


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _array(x: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


_FP_SCHEMA = pa.schema([("owner", pa.int32()), ("block", pa.int32()), ("prints", pa.binary()), ("sizes", pa.binary())])
_SHARED_SCHEMA = pa.schema([("block", pa.int32()), ("prints", pa.binary())])
_PIECE_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("lengths", pa.binary()), ("bytes", pa.binary()), ("docs", pa.binary()), ("rows", pa.binary()), ("starts", pa.binary()), ("parts", pa.binary())])
_MARK_SCHEMA = pa.schema([("block", pa.int32()), ("marks", pa.binary())])
_OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])


def _short(f: np.ndarray) -> np.ndarray:
    """What travels of fingerprints: 39 bits, and a lowest bit of zero. If two agree in these, both are taken for one, which only sends more."""
    return f >> np.uint64(24) & ~np.uint64(1)


def _pack(x: np.ndarray) -> bytes:
    """Five bytes of each, the lowest bytes of all first: of ascending values the high ones compress to next to nothing."""
    return _blob(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T)


def _unpack(x: pa.Scalar) -> np.ndarray:
    planes = _array(x, np.uint8).reshape(5, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :5] = planes.T
    return out.view("<u8").ravel()


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _send_prints(table: pa.Table, owners: int) -> pa.Table:
    """The block's distinct fingerprints to their owners, each with the binary logarithm of the documents that have it."""
    block = table.column("block")[0].as_py()
    keys, data, offsets = _block(table)
    doc, _, _, f = _pieces(data, offsets)
    f = _short(f)
    _, same = np.unique(keys, return_inverse=True)  # rows of one doc_id are one document
    doc = same[doc]
    order = np.lexsort((doc, f))
    f, doc = f[order], doc[order]
    keep = np.ones(len(f), bool)
    keep[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
    f = f[keep]
    prints, n = np.unique(f, return_counts=True)
    sizes = np.log2(n).astype(np.uint8)
    cut = np.searchsorted(prints, [np.uint64((k << 40) // owners) for k in range(1, owners)]).tolist()
    rows = [(k, block, _pack(prints[a:b]), _blob(sizes[a:b])) for k, (a, b) in enumerate(zip([0, *cut], [*cut, len(prints)], strict=True)) if b > a]
    return _rows(rows, _FP_SCHEMA)


def _answer_prints(table: pa.Table) -> pa.Table:
    """To each block, those of its fingerprints that two documents have; the lowest bit tells the crowded ones."""
    blocks = table.column("block").to_numpy()
    each = [_unpack(x) for x in table.column("prints")]
    sizes = np.concatenate([_array(x, np.uint8) for x in table.column("sizes")])
    prints = np.concatenate(each)
    origin = np.repeat(np.arange(len(each)), [len(x) for x in each])
    order = np.argsort(prints, kind="stable")
    p, w = prints[order], (1 << sizes[order].astype(np.int64))
    first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
    total = np.add.reduceat(w, first)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(p))))
    shared = total[group] >= 2
    value = p | (total[group] >= CROWDED).astype(np.uint64)
    o, v = origin[order][shared], value[shared]
    back = np.argsort(o, kind="stable")
    o, v = o[back], v[back]
    cut = np.searchsorted(o, np.arange(len(each) + 1))
    rows = [(int(blocks[k]), _pack(v[cut[k] : cut[k + 1]])) for k in range(len(each)) if cut[k + 1] > cut[k]]
    return _rows(rows, _SHARED_SCHEMA)


def _merge_spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """(doc, start, stop) rows, overlapping and touching spans of a document joined."""
    if not len(doc):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    shift = np.int64(max(int(stop.max()), 0) + 2)
    rank = np.concatenate(([0], np.cumsum(doc[1:] != doc[:-1])))
    reach = np.maximum.accumulate(stop + rank * shift)
    new = np.ones(len(doc), bool)
    new[1:] = (start + rank * shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([doc[first], start[first], np.maximum.reduceat(stop, first)], axis=1)


def _send_pieces(docs: pa.Table, shared: pa.Table, shards: int) -> pa.Table:
    if not docs.num_rows or not shared.num_rows:
        return _PIECE_SCHEMA.empty_table()
    block = docs.column("block")[0].as_py()
    keys, data, offsets = _block(docs)
    doc, first, last, f = _pieces(data, offsets)
    wanted = np.sort(np.concatenate([_unpack(x) for x in shared.column("prints")]))
    short = _short(f)
    at = np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)
    hit = (wanted[at] | np.uint64(1)) == (short | np.uint64(1))
    doc, first, last, f, crowded = doc[hit], first[hit], last[hit], f[hit], (wanted[at[hit]] & np.uint64(1)) == 1
    order = np.argsort(f, kind="stable")  # equal pieces have equal fingerprints: what is remembered goes with the fingerprint
    doc, first, last, f, crowded = doc[order], first[order], last[order], f[order], crowded[order]
    edge = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1]))) if len(f) else np.zeros(0, np.int64)
    alone = (np.repeat(np.diff(np.append(edge, len(f))), np.diff(np.append(edge, len(f)))) == 1) & ~crowded
    raw, ids = data.tobytes(), keys.tolist()
    sent, home = array("q"), array("q")  # document, first and last string, hash; document, start, stop
    seen: dict[bytes, int] = {}
    at, rest = None, np.flatnonzero(~alone)
    for lo in range(0, len(rest), 1 << 16):
        some = rest[lo : lo + (1 << 16)]
        for d, a, b, h, many in zip(*(x[some].tolist() for x in (doc, first, last, f, crowded)), strict=True):
            if h != at:
                seen, at = {}, h
            for x, y in ((x, x) for x in range(a, b + 1)) if many else ((a, b),):
                piece = raw[x : y + LENGTH]
                owner = seen.setdefault(piece, ids[d])
                if owner == ids[d]:  # the smallest doc_id of the block with it, as documents come in ascending order
                    sent.extend((d, x, y, zlib.crc32(piece) if many else h >> 1))
                else:
                    home.extend((d, x - offsets[d], y + LENGTH - offsets[d]))
    more = np.frombuffer(sent, np.int64).reshape(-1, 4)
    doc, first, last, h = (np.concatenate((x[alone], more[:, k])) for k, x in enumerate((doc, first, last, (f >> np.uint64(1)).astype(np.int64))))
    part = (h // shards % PARTS).astype(np.uint8)
    h %= shards
    order = np.lexsort((first, h))  # in the order of the texts, which compresses best
    doc, first, last, part, h = doc[order], first[order], last[order], part[order], h[order]
    edge = np.searchsorted(h, np.arange(shards + 1)).tolist()
    out, rows, size = [], [], 0
    if home:
        spans = np.frombuffer(home, np.int64).reshape(-1, 3)
        rows.append((-1 - block, block, b"", _blob(_merge_spans(spans[:, 0], spans[:, 1], spans[:, 2])), b"", b"", b"", b""))
    for shard in range(shards):
        a, b = edge[shard], edge[shard + 1]
        if a == b:
            continue
        d, x, y = doc[a:b], first[a:b], last[a:b] + LENGTH
        body = b"".join([raw[i:j] for i, j in zip(x.tolist(), y.tolist(), strict=True)])
        rows.append((shard, block, _blob((y - x).astype(np.uint32)), body, _blob(keys[d]), _blob(d.astype(np.uint32)), _blob((x - offsets[d]).astype(np.uint32)), _blob(part[a:b])))
        size += len(body)
        if size >= _STEP:
            out.append(_rows(rows, _PIECE_SCHEMA))
            rows, size = [], 0
    return pa.concat_tables([*out, _rows(rows, _PIECE_SCHEMA)])


def _string_hashes(text: np.ndarray) -> np.ndarray:
    """Hashes of all strings of LENGTH bytes (50 = 32 + 16 + 2), by doubling."""
    n = len(text) - LENGTH + 1
    out = np.empty(max(n, 0), np.uint64)
    for lo in range(0, n, _STEP):
        hi = min(n, lo + _STEP)
        two = _BYTE[text[lo : hi + LENGTH - 1]]
        two = two[:-1] * _ODD[1] + two[1:]
        h = two
        for reach, odd in ((2, _ODD[2]), (4, _ODD[3]), (8, _ODD[4])):
            h = h[:-reach] * odd + h[reach:]
        long = h[:-16] * _ODD[5] + h[16:]
        out[lo:hi] = mix(long[: hi - lo] * _ODD[1] + h[32 : 32 + hi - lo] * _ODD[2] + two[48 : 48 + hi - lo])
    return out


def smallest_owners(pieces: list[bytes], owners: np.ndarray) -> list[np.ndarray]:
    """For each of the distinct pieces and each of its strings of LENGTH bytes, the smallest owner of an equal string in any piece.

    Strings whose hash is met once have no equal and aren't sorted; what is left of the pieces is.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(bytes([SEPARATOR]).join(pieces), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    counts = sizes - LENGTH + 1
    ends = np.cumsum(counts)
    piece_of = np.repeat(np.arange(len(pieces)), counts)
    place = np.arange(int(ends[-1])) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
    out = owners[piece_of]
    h = _string_hashes(text)[place]
    ranked = np.sort(h)
    met = ranked[1:][ranked[1:] == ranked[:-1]]
    if len(met):
        met = met[np.concatenate(([True], met[1:] != met[:-1]))]
        again = np.flatnonzero(met[np.minimum(np.searchsorted(met, h), len(met) - 1)] == h)
        _sort_strings(text, place, again, out)
    return np.split(out, ends[:-1])


def _sort_strings(text: np.ndarray, place: np.ndarray, again: np.ndarray, out: np.ndarray) -> None:
    """Give the strings numbered `again` (at `place` in text) the smallest owner among equal ones, by a suffix array of their runs."""
    new = np.ones(len(again), bool)
    new[1:] = (np.diff(again) != 1) | (np.diff(place[again]) != 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(again)))
    size = length + LENGTH  # with the separator
    stop = np.cumsum(size)
    source = np.arange(int(stop[-1])) + np.repeat(place[again[first]] - (stop - size), size)
    part = text[np.minimum(source, len(text) - 1)].copy()
    part[stop - 1] = SEPARATOR
    at = np.arange(len(again)) - np.repeat(first, length) + np.repeat(stop - size, length)  # the strings' places in part
    string = np.full(len(part), -1)
    string[at] = again
    sa = suffix_array(part, 256)
    common = permuted_common_prefixes(part, sa, LENGTH)
    group = np.cumsum(common[sa] < LENGTH)
    keep = string[sa] >= 0
    which, group = string[sa][keep], group[keep]
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    out[which] = np.repeat(np.minimum.reduceat(out[which], head), np.diff(np.append(head, len(which))))


def _sort_shard(table: pa.Table) -> pa.Table:
    if table.column("shard")[0].as_py() < 0:  # marks on their way home
        return pa.Table.from_arrays([table.column("block"), table.column("bytes")], schema=_MARK_SCHEMA)
    def all_of(name: str, kind) -> np.ndarray:
        return np.concatenate([_array(x, kind) for x in table.column(name)])

    docs, lengths, part = all_of("docs", np.int64), all_of("lengths", np.uint32).astype(np.int64), all_of("parts", np.uint8)
    places, starts = all_of("rows", np.uint32), all_of("starts", np.uint32)
    blocks = table.column("block").to_numpy()
    origin = np.repeat(np.arange(len(blocks)), [len(x.as_buffer()) // 4 for x in table.column("lengths")])
    raw = b"".join([x.as_buffer() for x in table.column("bytes")])
    begin = np.cumsum(lengths) - lengths
    volume = np.bincount(part, lengths, PARTS)
    turn = ((np.cumsum(volume) - volume) // SORTED)[part]  # equal strings are in one part, and a part in one turn
    order = np.argsort(turn, kind="stable")
    cuts = np.flatnonzero(np.diff(turn[order])) + 1
    spans = [np.zeros((0, 3), np.int64)]
    for these in np.split(order, cuts):
        distinct: dict[bytes, int] = {}
        number = np.array([distinct.setdefault(raw[a : a + n], len(distinct)) for a, n in zip(begin[these].tolist(), lengths[these].tolist(), strict=True)])
        owners = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(owners, number, docs[these])
        least = smallest_owners(list(distinct), owners)
        counts = np.array([len(x) for x in least])
        pool, head = np.concatenate(least), np.cumsum(counts) - counts
        n = counts[number]
        ends = np.cumsum(n)
        inside = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        gone = pool[np.repeat(head[number], n) + inside] < np.repeat(docs[these], n)
        row = these[np.repeat(np.arange(len(these)), n)[gone]]
        start = starts[row] + inside[gone]
        spans.append(_merge_spans((origin[row] << 32) + places[row], start, start + LENGTH))
    spans = np.concatenate(spans)
    spans = _merge_spans(spans[:, 0], spans[:, 1], spans[:, 2])
    edge = np.searchsorted(spans[:, 0] >> 32, np.arange(len(blocks) + 1))
    spans[:, 0] &= (1 << 32) - 1
    return _rows([(int(blocks[k]), _blob(spans[a:b])) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a], _MARK_SCHEMA)


def _remove(docs: pa.Table, marks: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return _OUT_SCHEMA.empty_table()
    keys, data, offsets = _block(docs)
    raw = data.tobytes()
    rows = [_array(x, np.int64).reshape(-1, 3) for x in marks.column("marks")] if marks.num_rows else []
    rows = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
    spans = _merge_spans(rows[:, 0], rows[:, 1], rows[:, 2])
    low, high = (np.searchsorted(spans[:, 0], np.arange(len(keys)), side) for side in ("left", "right"))  # marks name a document by its place in the block
    n, cut, kept = [], [], []
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), low.tolist(), high.tolist(), strict=True):
        mine = [(s, min(e, b - a)) for s, e in spans[i:j, 1:].tolist() if s < b - a]
        left, at = [], a
        for s, e in mine:
            left.append(raw[at : a + s])
            at = a + e
        left.append(raw[at:b])
        n.append(b - a)
        cut.append([x for span in mine for x in span])
        kept.append(b"".join(left))
    return pa.Table.from_arrays([pa.array(keys, mask=keys == _NULL), pa.array(n, pa.int64()), pa.array(cut, pa.list_(pa.int64())), pa.array(kept, pa.binary())], schema=_OUT_SCHEMA)


def _blocks(texts: DataFrame) -> int:
    """As many blocks as BLOCK bytes in each ask for, however the input is partitioned; more, of 1 MB at least, for tasks of twice the partitions."""
    size = texts.agg(F.sum(F.octet_length("text") + ROW)).first()[0] or 0
    return max(8, -(-size // BLOCK), min(2 * texts.rdd.getNumPartitions(), size >> 20))


def cut_repeats(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (start and stop of each removed run, flat), kept (what remains, as bytes)."""
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = blocks or _blocks(texts)
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartitionById(n, "block")
    prints = dealt.groupBy("block").applyInArrow(lambda t: _send_prints(t, n), "owner int, block int, prints binary, sizes binary")
    shared = prints.repartitionById(n, "owner").groupBy("owner").applyInArrow(_answer_prints, "block int, prints binary").repartitionById(n, "block")
    pieces = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lambda a, b: _send_pieces(a, b, n), "shard int, block int, lengths binary, bytes binary, docs binary, rows binary, starts binary, parts binary")
    marks = pieces.repartitionById(n, "shard").groupBy("shard").applyInArrow(_sort_shard, "block int, marks binary").repartitionById(n, "block")
    return dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_remove, "doc_id long, n_bytes long, spans array<long>, kept binary")
