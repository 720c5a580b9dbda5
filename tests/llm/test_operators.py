import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscan.llm import decontaminate, line_dedup, near_dedup, packing, pairwise_quality, quality_rules, sharding, substring_dedup, token_output, warc_fixity

P = pytest.importorskip("public_tokenizers")
COMMON = "".join(chr(97 + i * i % 26) for i in range(70))
ROWS = [
    (1, "head " + COMMON + " tail one"),
    (2, COMMON[5:] + " and more text that is new " + "z" * 120),
    (3, None),
    (4, ""),
    (5, "z" * 90),
    (6, "é" * 40 + COMMON),
    (7, "head " + COMMON + " tail one"),
    (7, COMMON),
    (9, "short"),
]


def _cut_brute(rows):
    """What a byte-by-byte reading of the rule removes: counts of (doc_id, digest of what is kept, bytes, spans)."""
    first, out = {}, collections.Counter()
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(k, first.get(b[i : i + 50], k))
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out[k, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest(), len(b), tuple(edge.tolist())] += 1
    return out


@pytest.mark.parametrize("crowded", [1 << 14, 2])
def test_substring_dedup(frame, monkeypatch, crowded):
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    got = collections.Counter((r.doc_id, hashlib.sha256(r.kept).hexdigest(), r.n_bytes, tuple(r.spans)) for r in substring_dedup.cut_repeats(frame(ROWS, clash=True), blocks=3).collect())
    assert got == _cut_brute(ROWS)


def test_substring_dedup_of_many(frame):
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("abcd ef"), 60)) for _ in range(12)]
    rows = [(i, " ".join([*rng.choice(pool, rng.integers(0, 4)), "".join(rng.choice(list("xyz"), rng.integers(0, 90)))])) for i in range(60)]
    got = collections.Counter((r.doc_id, hashlib.sha256(r.kept).hexdigest(), r.n_bytes, tuple(r.spans)) for r in substring_dedup.cut_repeats(frame(rows), blocks=4).collect())
    assert got == _cut_brute(rows)


@pytest.mark.parametrize("blocks", [1, 2, 3, 8])
def test_null_doc_ids_are_the_smallest_in_any_number_of_blocks(frame, blocks):
    rng = np.random.default_rng(8)
    t = "".join(rng.choice(list("abcdefgh"), 400))
    rows = [(None, t), (5, t + "!"), (9, t + "?"), (None, t[100:300]), (2, "x" + t[50:])]
    got = collections.Counter((r.doc_id, hashlib.sha256(r.kept).hexdigest(), r.n_bytes, tuple(r.spans)) for r in substring_dedup.cut_repeats(frame(rows), blocks=blocks).collect())
    want = collections.Counter({(None if k[0] < 0 else k[0], *k[1:]): n for k, n in _cut_brute([(-1 if k is None else k, t) for k, t in rows]).items()})
    assert got == want


def test_substring_dedup_in_small_steps(spark, frame, monkeypatch):
    """Blocks follow the bytes of the texts, not the partitions of the input; slices and turns of a few strings change nothing."""
    monkeypatch.setattr(substring_dedup, "BLOCK", 1 << 10)
    rng = np.random.default_rng(6)
    pool = ["".join(rng.choice(list("abcd ef"), 75)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(pool, rng.integers(0, 4)))) for i in range(90)] + [(None, pool[0] + "n" * 60), (None, "n" * 60 + pool[1])]
    docs = frame(rows).coalesce(1)
    assert substring_dedup._blocks(docs) == -(-sum(len(t) + 64 for _, t in rows) // 1024)
    got = collections.Counter((r.doc_id, hashlib.sha256(r.kept).hexdigest(), r.n_bytes, tuple(r.spans)) for r in substring_dedup.cut_repeats(docs).collect())
    want = collections.Counter({(None if k[0] < 0 else k[0], *k[1:]): n for k, n in _cut_brute([(-1 if k is None else k, t) for k, t in rows]).items()})
    assert got == want
    monkeypatch.setattr(substring_dedup, "_STEP", 7)
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for _, t in rows])))
    f, pieces = substring_dedup.fingerprints(data), []
    for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        for i in range(a, b - 49):
            if pieces and pieces[-1][0] == d and pieces[-1][3] == f[i]:
                pieces[-1][2] = i
            else:
                pieces.append([d, i, i, f[i]])
    assert [list(x) for x in zip(*substring_dedup._pieces(data, offsets))] == pieces


@pytest.mark.parametrize("crowded", [1 << 14, 2])
def test_substring_dedup_in_process(monkeypatch, crowded):
    """The steps one after the other in this process, where patched limits hold: turns of one part, crowded fingerprints."""
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    monkeypatch.setattr(substring_dedup, "SORTED", 1)
    rng = np.random.default_rng(8)
    pool = ["".join(rng.choice(list("abcd ef"), 80)) for _ in range(12)]
    rows = [*[(k, t or "") for k, t in ROWS], *[(20 + i // 2, " ".join(rng.choice(pool, rng.integers(0, 4)))) for i in range(90)]]
    n, schema = 3, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("block", pa.int64())])
    blocks = [pa.Table.from_pylist([{"doc_id": k, "text": t, "block": b} for i, (k, t) in enumerate(rows) if i % n == b], schema) for b in range(n)]

    def groups(tables, column):
        whole = pa.concat_tables(tables)
        return {k: whole.filter(pc.equal(whole.column(column), k)) for k in set(whole.column(column).to_pylist())}

    shared = groups([substring_dedup._answer_prints(t) for t in groups([substring_dedup._send_prints(b, n) for b in blocks], "owner").values()], "block")
    pieces = groups([substring_dedup._send_pieces(b, shared[k], n) for k, b in enumerate(blocks)], "shard")
    marks = groups([substring_dedup._sort_shard(t) for t in pieces.values()], "block")
    out = [r for k, b in enumerate(blocks) for r in substring_dedup._remove(b, marks.get(k, substring_dedup._MARK_SCHEMA.empty_table())).to_pylist()]
    assert collections.Counter((r["doc_id"], hashlib.sha256(r["kept"]).hexdigest(), r["n_bytes"], tuple(r["spans"])) for r in out) == _cut_brute(rows)


def test_fingerprints_travel_short():
    x = np.sort(np.random.default_rng(9).integers(0, 1 << 40, 999).astype(np.uint64))
    packed = substring_dedup._pack(x)
    assert len(packed) == 5 * 999 and (substring_dedup._unpack(pa.scalar(packed)) == x).all()
    assert len(substring_dedup._unpack(pa.scalar(substring_dedup._pack(x[:0])))) == 0
    f = np.array([2**64 - 1, 2**64 - 2**25, 2**25 - 1], np.uint64)  # the first two agree in 39 bits
    assert substring_dedup._short(f).tolist() == [2**40 - 2, 2**40 - 2, 0]


def test_substring_dedup_memory():
    """What a worker holds beside a block and a shard is a few bytes for each byte of them."""
    import tracemalloc

    rng = np.random.default_rng(7)
    texts = [bytes(x).decode() for x in rng.integers(97, 123, (800, 10_000), np.uint8)]
    block = pa.table({"doc_id": pa.array(range(800)), "text": texts, "block": pa.array([0] * 800)})
    size, peaks = 8_000_000, []
    pieces = pa.table({"block": [0], "prints": [substring_dedup._pack(np.unique(substring_dedup._short(substring_dedup._pieces(*substring_dedup._block(block)[1:])[3])))]})
    steps = [lambda: substring_dedup._send_prints(block, 4), lambda: substring_dedup._send_pieces(block, pieces, 4), lambda: substring_dedup._sort_shard(shard)]
    for step in steps:
        tracemalloc.start()
        out = step()
        peaks.append(tracemalloc.get_traced_memory()[1] / size)
        tracemalloc.stop()
        if len(peaks) == 2:
            rows = [dict(r, block=b) for r in out.to_pylist() if r["shard"] == 0 for b in (0, 1)]
            shard = pa.Table.from_pylist(rows, out.schema)
    assert max(peaks) < 16, peaks


def _line_brute(rows, min_chars, window):
    """What maximal repeated runs say, position by position: (doc_id, kept text, lines, removed), and the number of windows."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, _signed(xxhash.xxh64_intdigest((rows[r][1] or "").encode(), 42)), rows[r][1] is not None))
    lines = [[x.strip(" \t\v\f\r") for x in (rows[r][1] or "").split("\n")] for r in order]
    solid = [[i for i, x in enumerate(ls) if x] for ls in lines]
    texts = [[ls[i] for i in so] for ls, so in zip(lines, solid)]
    gone = [set() for _ in order]
    for b, y in enumerate(texts):
        for a in range(b + 1):
            x = texts[a]
            for j in range(len(y)):
                for i in range(len(x) if a < b else j):
                    k = 0
                    while i + k < len(x) and j + k < len(y) and x[i + k] == y[j + k]:
                        k += 1
                    if k and (k >= window or sum(map(len, y[j : j + k])) >= min_chars):
                        gone[b].update(range(j, j + k))
    out = collections.Counter()
    for r, ls, so, g in zip(order, lines, solid, gone):
        raw = (rows[r][1] or "").split("\n")
        drop = {so[j] for j in g}
        out[rows[r][0], "\n".join(x for i, x in enumerate(raw) if i not in drop) if g else rows[r][1], len(so), len(g)] += 1
    return out


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _lines(docs, **kw):
    return collections.Counter((r[0], r[1], r["_n_lines"], r["_n_removed"]) for r in line_dedup.dedup_lines(docs, **kw).collect())


def test_line_dedup_on_odd_rows(frame):
    long = "a line that is long enough to count as a repeat all by itself, really"
    short = "\n".join("abcdefgh")
    rows = [(1, f"x\n{long}\ny"), (2, f"u\n {long}\t\nv\n\nw"), (3, short), (4, f"1\n{short}\n2"), (5, "a\nb\nc"), (6, None), (7, ""), (8, long), (None, long), (None, long), (9, long), (9, long), (9, "q")]
    docs = frame(rows, clash=True).withColumn("_N_LINES", F.lit(1))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns[:-1], "_N_LINES_in", "_n_lines", "_n_removed"]
    got = _lines(docs)
    # the null doc_id comes first and one of its two rows is the first of all
    want = {(None, long, 1, 0): 1, (None, "", 1, 1): 1, (1, "x\ny", 3, 1): 1, (2, "u\nv\n\nw", 4, 1): 1, (3, short, 8, 0): 1, (4, "1\n2", 10, 8): 1, (5, "a\nb\nc", 3, 0): 1, (6, None, 0, 0): 1, (7, "", 0, 0): 1, (8, "", 1, 1): 1, (9, "", 1, 1): 2, (9, "q", 1, 0): 1}
    assert got == collections.Counter(want) == _line_brute(rows, line_dedup.MIN_CHARS, line_dedup.WINDOW)


@pytest.mark.parametrize("bounds", [(1 << 20, 2), (6, 3), (5, 8), (1 << 20, 1)])
def test_line_dedup_against_brute_force(frame, bounds):
    rng = np.random.default_rng(bounds[1])
    rows = [(i, "\n".join(rng.choice(["a", "bb", "ccc", "", "dddd", "e e"], rng.integers(0, 9)))) for i in range(50)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1])]
    assert _lines(frame(rows), min_chars=bounds[0], window=bounds[1]) == _line_brute(rows, *bounds)


def test_line_dedup_of_very_long_texts(frame):
    long = "\n".join(f"line number {i} of a very long text that two documents share, {i * i}" for i in range(20_000))
    got = _lines(frame([(1, long), (2, "before\n" + long + "\nafter"), (3, "word " * 200_000)]))
    assert got == {(1, long, 20_000, 0): 1, (2, "before\nafter", 20_002, 20_000): 1, (3, "word " * 200_000, 1, 0): 1}


def test_only_window_minima_are_fingerprints(frame, monkeypatch):
    text = "\n".join(f"k{i}" for i in range(64))
    docs = frame([(1, text), (2, "x\n" + text)])
    picked = line_dedup._selected(docs, 1 << 20, 8)
    assert 8 <= picked.filter("fp is not null").count() / 2 <= 24  # about 2 of 9 lines
    assert _lines(docs, min_chars=1 << 20)[2, "x", 65, 64] == 1
    monkeypatch.setattr(line_dedup, "_selected", lambda *a: picked.limit(0))
    assert _lines(docs, min_chars=1 << 20)[2, "x\n" + text, 65, 0] == 1


def _xx(key: str, shard: int) -> int:
    seed = xxhash.xxh64_intdigest(key.encode(), 42)
    return xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed)


def test_sharding(frame):
    rows = [(i, f"t{i}" if i % 5 else None) for i in range(300)] + [(None, "n"), (3, "t3"), (3, "t3")]
    got = sharding.assign(frame(rows, clash=True), 7).collect()
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        if r.doc_id is not None and r.doc_id not in (None,):
            text = dict(rows)[r.doc_id] or ""
            assert (r.size, r.text_crc32, r.law) == (len(text) + 16, zlib.crc32(text.encode()), "key")
        assert r.grown_shard in (r.shard, 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_key = {r.doc_id: r.shard for r in got}
    for r in sharding.assign(frame([(i, "") for i in range(300)]), 8).collect():
        assert r.shard in (by_key[r.doc_id], 7)
    for k in (0, 17, 255):
        score = [1 / -math.log(((_xx(str(k), s) >> 11) + 0.5) / 2**53) for s in range(7)]
        assert by_key[k] == int(np.argmax(score))
    heavy = collections.Counter(r.shard for r in sharding.place(frame([(i, "") for i in range(2000)]), "doc_id", [3.0, 1.0]).collect())
    assert 0.68 < heavy[0] / 2000 < 0.82
    odd = sharding.place(frame([(1, "a"), (None, "b")]).withColumn("Shard", F.lit("s")).withColumn("DOC", F.lit(1)).toDF("doc_id", "text", "Shard", "DOC_ID"), "doc_id", [1.0] * 4)
    assert odd.columns == ["doc_id", "text", "Shard_in", "DOC_ID", "shard"]
    assert {(r[0], r[4]) for r in odd.collect()} == {(k, int(np.argmax([1 / -math.log(((_xx("null" if k is None else str(k), s) >> 11) + 0.5) / 2**53) for s in range(4)]))) for k in (1, None)}
    sizes = [(r.doc_id, r.size) for r in sharding.assign(frame([(1, "é" * 300_000), (2, None)]), 3).collect()]
    assert sorted(sizes) == [(1, 600_016), (2, 16)]


TOKEN_ROWS = [(1, "Hello there, world"), (2, None), (3, ""), (4, "same"), (4, "same"), (5, "x" * 30000 + " y" * 3000), (None, "null id"), (9, " lead  two")]


def test_token_segments(frame, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "SEGMENT_IDS", 40)
    monkeypatch.setattr(token_output, "CHUNK", 30)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = token_output.round_trip(frame(TOKEN_ROWS, clash=True), P.path("word_bpe_49k.json"), 1).collect()
    want, at = [], 0
    for k, text in sorted(TOKEN_ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert token_output.round_trip(frame([]), P.path("word_bpe_49k.json")).count() == 0


def test_token_segments_are_read_through_select(frame, monkeypatch):
    """Boundaries and doc_ids are decoded a directory entry at a time, never all at once."""
    from folioscan.llm import elias_fano

    longest = []
    block = elias_fano.Sequence.block
    monkeypatch.setattr(elias_fano.Sequence, "block", lambda s, j: longest.append(1) or block(s, j))
    lengths = np.arange(1, 3001)
    s = elias_fano.Segment(elias_fano.write_segment(0, 0, [None, None, *range(10, 3008)], lengths, np.zeros(int(lengths.sum()), np.uint32)))
    spans = s.spans()
    assert [next(spans) for _ in range(3)] == [(None, 0, 1), (None, 1, 3), (10, 3, 6)]
    assert len(longest) == 2  # one block of ends, one of doc_ids
    assert [(s.doc_id(i), *s.span(i)) for i in (0, 2, 700, 2999)] == [x for i, x in enumerate(s.spans()) if i in (0, 2, 700, 2999)]


def test_packing(frame):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    limits = packing.Limits(64, 4, 60)
    got = packing.pack_documents(frame(TOKEN_ROWS, clash=True), P.path("byte_bpe_50k.json"), 0, limits).collect()
    sequences = collections.defaultdict(list)
    per_doc = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        per_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and len(rs) <= 4 and sum(r.loss for r in rs) <= 60
    copies = collections.Counter(k for k, _ in TOKEN_ROWS)
    crcs = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got)
    for k, text in TOKEN_ROWS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert sum(length for _, length, _ in per_doc[k]) == len(ids) * copies[k]
        assert {n for _, _, n in per_doc[k]} == {len(ids)}
        for start, length, _ in per_doc[k]:
            assert crcs[k, start, length, zlib.crc32(ids[start : start + length].tobytes())] == copies[k]
    assert packing.pack_documents(frame([]), P.path("byte_bpe_50k.json")).count() == 0


def test_packing_at_the_default_limits(spark):
    """All documents of the smallest table: checksums of the library's ids, nothing over 1024, little padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got, load = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), 0).collect(), collections.Counter()
    for r in got:
        load[r.sequence_id] += r.length
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in docs.collect()}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) for r in got)
    assert sum(load.values()) == sum(map(len, ids.values())) and max(load.values()) <= 1024
    assert sum(load.values()) / (1024 * len(load)) > 0.97


def test_each_limit_binds_somewhere():
    """Short pieces run out of segments, answers out of loss-bearing tokens, prompts out of tokens; none passes its limit."""
    rng = np.random.default_rng(4)
    kinds = [(rng.integers(1, 4, 300), 0.5), (rng.integers(40, 90, 200), 1.0), (rng.integers(40, 90, 200), 0.1)]
    limits = np.array([1024, 64, 600])
    full = []
    for lengths, share in kinds:
        d = np.stack([lengths, np.ones_like(lengths), (lengths * share).astype(int)], axis=1)
        bins, _ = packing.pack_vectors(d, limits)
        load = np.zeros((bins.max() + 1, 3), np.int64)
        np.add.at(load, bins, d)
        assert (load <= limits).all()
        full.append(int((load[0] / limits).argmax()))
    assert full == [1, 2, 0]


def test_vector_packing_keeps_all_limits():
    rng = np.random.default_rng(2)
    d = np.stack([rng.integers(1, 101, 800), np.ones(800, np.int64), rng.integers(0, 90, 800)], axis=1)
    limits = np.array([100, 5, 90])
    bins, places = packing.pack_vectors(d, limits)
    load = np.zeros((bins.max() + 1, 3), np.int64)
    np.add.at(load, bins, d)
    assert (load <= limits).all() and (load[:, 1] > 0).all()
    assert all(sorted(places[bins == b]) == list(range(load[b, 1])) for b in range(len(load)))
    assert len(load) <= 1.1 * max(d.sum(axis=0) / limits)


BENCH = [("q1", "the quick brown fox jumps over the lazy dog and runs away far"), ("q2", "tiny item"), ("q3", None), ("q4", "..."), (None, "unnamed thing here"), ("q1", "the quick brown fox jumps over the lazy dog and runs away far")]
DOCS = [(1, "So The QUICK-brown fox jumps over the lazy dog and runs away. Tiny item!"), (2, "quick brown fox"), (3, None), (4, ""), (5, "a tiny tiny item"), (6, "an unnamed thing here"), (6, "an unnamed thing here"), (7, "!!!")]


def _hits(docs, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = collections.defaultdict(set)
    for item, t in bench:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            wins[tuple(w[i : i + n])].add(item)
    out = []
    for k, t in docs:
        w, hit, items = words(t), set(), set()
        for win, of in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    items |= of
        out.append((k, len(w), len(hit), sorted(x for x in items if x is not None), bool(hit)))
    return out


def test_equal_benchmark_items_are_one(spark, frame, monkeypatch):
    """100,000 equal rows and rows without an id are dealt as distinct items, in blocks of bounded size."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    item = " ".join(f"w{i}" for i in range(12))
    same = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, "q").alias("item_id"), F.lit(item).alias("text"))
    more = spark.createDataFrame([(f"i{k}", " ".join(f"x{k}y{i}" for i in range(11))) for k in range(90)], "item_id string, text string")
    sizes = [len(ix.start) for ix in decontaminate.indexes(frame([(1, item)]), same.unionByName(more))]
    assert 2 < len(sizes) < 8
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.report(frame([(1, "a " + item), (2, "x7y0 " + " ".join(f"x7y{i}" for i in range(11))), (3, "clean")]), same.unionByName(more)).collect()}
    assert got[1][0] == 12 and "q" in got[1][1] and got[2] == (11, ["i7"]) and got[3] == (0, [])


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_decontamination(spark, frame, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)  # the second makes several passes
    bench = spark.createDataFrame(BENCH, "item_id string, text string").withColumn("x", F.lit("q")).toDF("item_id", "text", "TEXT")
    docs = frame(DOCS, clash=True)
    got = sorted((tuple(r) for r in decontaminate.report(docs, bench).collect()), key=repr)
    assert got == sorted(_hits(DOCS, BENCH), key=repr)
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r[0] for r in left.collect()) == sorted(k for k, _, n, _, _ in _hits(DOCS, BENCH) if not n)
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(DOCS)
    assert decontaminate.report(frame([]), bench).count() == 0


def _near_brute(rows):
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    sets = []
    for _, t in rows:
        w = words(t)
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or union and len(sets[i] & sets[j]) / union >= 0.8:
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return collections.Counter((k, least.get(root(i))) for i, (k, _) in enumerate(rows))


def test_near_dedup(frame):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(12):
        base = list(rng.choice(vocabulary, 150))
        for c in range(rng.integers(1, 9)):
            text = base.copy()
            for _ in range(rng.integers(0, 5)):
                text[rng.integers(0, 150)] = str(rng.choice(vocabulary))
            rows.append((len(rows) * 3, " ".join(text)))
    rows += [(900, None), (901, ""), (902, "..."), (903, "..."), (904, "two words"), (905, "Two, words"), (5, rows[0][1]), (0, "another text of the same number"), (None, rows[0][1]), (None, "alone"), (7, rows[3][1]), (7, rows[3][1])]
    docs = frame(rows, clash=True)
    got = collections.Counter((r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect())
    assert got == _near_brute(rows)
    left = near_dedup.distinct(docs)
    assert left.columns == docs.columns
    assert left.count() == len({(c, "") for _, c in got if c is not None}) + 1 + 1  # one alone without number, two classes numbered 0


def test_near_dedup_of_a_hot_group(frame):
    """Copies of one text, each with its own changes: linked to the original, hardly to each other."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(80):
        text = base.copy()
        for k in range(3 + i % 4):
            text[rng.integers(0, 200)] = f"new{i}x{k}"
        rows.append((i, " ".join(text)))
    got = collections.Counter((r.doc_id, r.class_id) for r in near_dedup.classes(frame(rows)).collect())
    assert got == _near_brute(rows)


def test_near_dedup_where_the_differing_part_is_repeated(frame):
    """Pairs at plain 0.8: 100 shared shingles and 25 of a footer that is repeated."""
    rows = []
    for g in range(20):
        base, footer = [f"b{g}x{i}" for i in range(104)], [f"f{g}x{i}" for i in range(21)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base + footer * (10, 50, 100)[g % 3]))]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(frame(rows)).collect()}
    assert got == {k: k - k % 2 for k, _ in rows}


def test_near_dedup_recall_against_exact_pairs(spark):
    """Documents of sf0.01: the pairs of different texts at 0.8 or more, by shared shingles, and how many end in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, words(t)) for k, t in texts.items())}
    by_shingle, shared = collections.defaultdict(list), collections.Counter()
    for k, s in sets.items():
        for x in s:
            by_shingle[x].append(k)
    for ks in by_shingle.values():
        shared.update((a, b) for a in ks for b in ks if a < b)
    exact = [(a, b) for (a, b), n in shared.items() if texts[a] != texts[b] and n / (len(sets[a]) + len(sets[b]) - n) >= 0.8]
    found = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    met = sum(found[a] == found[b] for a, b in exact)
    assert len(exact) >= 10 and met / len(exact) >= 0.99


def test_documents_that_share_too_little(spark):
    """shared counts the shingles that another document has; who falls under 0.8 of his own cannot have a partner."""
    sets = {1: range(10), 2: range(2, 12), 3: range(100, 110), 4: [*range(8), 500, 501]}
    items = spark.createDataFrame([(k, bytearray(np.array(sorted(v), np.int64).tobytes())) for k, v in sets.items()], "id long, items binary")
    sizes = spark.createDataFrame([(k, 10) for k in sets], "id long, size long")
    got = {r.id: r.shared for r in near_dedup._shared(sizes.select("id"), items, sizes, 0.8).collect()}
    assert got == {1: 10, 2: 8, 4: 8}


def test_very_long_texts(spark, frame):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, long), (2, long + " tail of its own"), (3, "x" * 1_000_000)]
    assert {r.doc_id: r.class_id for r in near_dedup.classes(frame(rows)).collect()} == {1: 1, 2: 1, 3: 3}
    bench = spark.createDataFrame([("q", " ".join(f"w{i}" for i in range(119_980, 120_000)))], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.report(frame(rows), bench).collect()} == {1: 20, 2: 20, 3: 0}
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.kept) for r in quality_rules.rule_report(frame([(1, "the " + long), (4, "of it a b " * 600_000)])).collect()}
    assert got[1] == (120_001, 0, False) and got[4][:2] == (2_400_000, 2_400_000)
    cut = {r.doc_id: (r.n_bytes, sum(r.spans[1::2]) - sum(r.spans[::2])) for r in substring_dedup.cut_repeats(frame(rows), blocks=3).collect()}
    assert cut[1] == (len(long), 0) and cut[2] == (len(long) + 16, len(long))


def test_staging_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from folioscan.llm.common import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))
    assert shared_dir(SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs:///a/"}, sparkContext=context)) == "hdfs:///a"


def test_empty_tables(frame):
    empty = frame([])
    assert near_dedup.classes(empty).count() == 0
    assert near_dedup.distinct(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert quality_rules.rule_report(empty).count() == 0
    assert quality_rules.apply_rules(empty).count() == 0
    assert sharding.assign(empty).count() == 0
    assert substring_dedup.cut_repeats(empty).count() == 0


def _rules_brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(frame):
    prose = " ".join(f"the word{i} of and{i} more" for i in range(30))
    rows = [(1, prose), (2, None), (3, ""), (4, "a b a b a b a b\n\n x\nx\nx"), (5, " \t\n"), (6, prose + " ###" * 60), (7, prose.upper().replace(" ", "!! ")), (8, "the same of it " * 400), (8, "é日 the | x\n" * 30), (9, prose + "\n" + prose)]
    docs = frame(rows, clash=True)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.rule_report(docs).collect())
    assert got == collections.Counter((k, *_rules_brute(t)) for k, t in rows)
    kept = quality_rules.apply_rules(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == [1] == sorted(r.doc_id for r in quality_rules.rule_report(docs).filter("kept").collect())


def test_merkle_audit(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(300)] + [(None, None, None), (5, "again", "x"), (5, "again", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    audit = warc_fixity.audit(pages, pages).collect()
    assert {r.status for r in audit} == {"intact"} and len(audit) == len(rows)
    placed = sorted(audit, key=lambda r: r.ordinal)
    assert [r.ordinal for r in placed] == list(range(len(rows)))
    at = 0
    for r in placed:
        assert r.offset == at
        at += r.length
    hashes = {r.hash for r in warc_fixity.roots(pages, pages).collect()}
    assert len(hashes) == 1
    other = pages.filter("page_id <> 11 or page_id is null").withColumn("html", F.when(F.col("page_id") == 102, F.lit("bad")).otherwise(F.col("html"))).unionByName(spark.createDataFrame([(999, "u", "new"), (-4, "u", "first"), (5, "again", "x")], pages.schema))
    audit = warc_fixity.audit(pages.withColumn("x", F.lit(1)).toDF("page_id", "url", "html", "HTML"), other, fanout=4).collect()
    assert sorted(r.ordinal for r in audit) == list(range(len(rows) + 3))
    found = collections.Counter((r.page_id, r.status) for r in audit if r.status != "intact")
    # of key 5 there are three records against four: one is extra, and hashes met in another order may count as corrupt
    assert {k: n for k, n in found.items() if k[0] != 5} == {(11, "missing"): 1, (102, "corrupt"): 1, (999, "extra"): 1, (-4, "extra"): 1}
    assert found[5, "extra"] == 1 and found[5, "missing"] == 0
    assert all((r.offset is None) == (r.status == "extra") for r in audit)
    none = pages.limit(0)
    assert warc_fixity.audit(none, none).count() == 0
    assert {r.status for r in warc_fixity.audit(none, pages).collect()} == {"extra"}


def _merkle_brute(records, fanout):
    """The root over (node, length, hash) rows, level by level."""
    level, n = records, max(k for k, _, _ in records) + 1
    while n > 1:
        up = collections.defaultdict(list)
        for k, length, h in sorted(level):
            up[k // fanout].append((k, length, h))
        level = []
        for k, children in up.items():
            at, text = 0, []
            for c, length, h in children:
                text.append(f"{c}:{at}:{length}:{h}")
                at += length
            level.append((k, at, hashlib.sha256(",".join(text).encode()).hexdigest()))
        n = -(-n // fanout)
    return level[0][2]


def test_merkle_roots_tell_extra_and_cut_records(spark):
    rows = [(i, "u", f"page {i}") for i in range(50)]
    frame = lambda rs: spark.createDataFrame(rs, "page_id long, url string, html string")
    record = lambda k, u, h: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Target-URI: {u}\r\nContent-Type: text/html\r\nContent-Length: {len(h)}\r\n\r\n{h}\r\n\r\n".encode()
    for other in (rows + [(70, "u", "one more")], [(-1, "u", "ahead"), *rows], rows[:20] + rows[21:], rows[:7] + [(7, "u", "page ")] + rows[8:]):
        got = {r.replica: r.hash for r in warc_fixity.roots(frame(rows), frame(other), fanout=3).collect()}
        place = {k: i for i, k in enumerate(sorted({k for k, _, _ in rows + other}))}
        for name, mine in (("first", rows), ("second", other)):
            assert got[name] == _merkle_brute([(place[k], len(record(k, u, h)), hashlib.sha256(record(k, u, h)).hexdigest()) for k, u, h in mine], 3)
        assert got["first"] != got["second"]


def test_fixity_of_a_very_long_page(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 3_000_000), (2, "u", "y")], "page_id long, url string, html string")
    assert [(r.page_id, r.status) for r in warc_fixity.audit(pages, pages.filter("page_id = 1")).orderBy("ordinal").collect()] == [(1, "intact"), (2, "missing")]


def test_pairwise_quality(spark, frame):
    rng = np.random.default_rng(1)
    good = lambda: " ".join(rng.choice(["the", "of", "river", "stone", "walks", "green"], 60)) + "."
    bad = lambda: " ".join(x.upper() + "!!" for x in rng.choice(["buy", "now", "cash"], 40))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)] + [(500, None), (501, ""), (3, "twice")]
    docs = frame(rows, clash=True)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (7, None)], "doc_id long, quality int")
    out = pairwise_quality.score(docs, pairwise_quality.train(docs, labels, pairs=5000)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    right = [r.predicted == (r.doc_id % 3 > 0) for r in out if r.held_out and r.doc_id < 240 and r.doc_id != 3]
    assert np.mean(right) > 0.97
    flat = pairwise_quality.score(docs, pairwise_quality.train(docs, labels.limit(0))).collect()
    assert {r.score for r in flat} == {0.5}
    # repeated doc_ids, contradicting labels and more labelled rows than the bound: exactly `sample` doc_ids in training
    many = frame(rows + [(1, f"{good()} {i}") for i in range(50)] + [(600, "word " * 300_000)])
    odd = labels.unionByName(spark.createDataFrame([(2, 0), (2, 1)] * 3 + [(1, 1)] * 40, labels.schema))
    seen = []
    fit = pairwise_quality.fit
    pairwise_quality.fit = lambda x, good, pairs: seen.append((x.shape, int(good.sum()))) or fit(x, good, pairs)
    try:
        ranking = pairwise_quality.train(many, odd, sample=40, pairs=500)
        again = pairwise_quality.train(many.repartition(5), odd.repartition(2), sample=40, pairs=500)
    finally:
        pairwise_quality.fit = fit
    assert seen[0] == seen[1] and seen[0][0] == (40, len(pairwise_quality.FEATURES) + 3 * pairwise_quality.GRAMS)
    assert (ranking.weights == again.weights).all() and ranking.threshold == again.threshold
    assert pairwise_quality.score(frame([]), ranking).count() == 0
    assert len(pairwise_quality.score(many, ranking).collect()) == len(rows) + 51


def test_the_fit_minimises_the_logistic_loss():
    """At the weights found, the gradient of the loss, summed pair by pair, is 0, and no step beside them is better."""
    rng = np.random.default_rng(3)
    x, good = rng.normal(size=(60, 3)), np.arange(60) % 2 == 0
    x[good, 0] += 1
    r = pairwise_quality.fit(x, good, pairs=400, ridge=1e-3)
    z = (x - r.mean) / r.scale
    again = np.random.default_rng(7)
    first, second = again.choice(np.flatnonzero(good), 400), again.choice(np.flatnonzero(~good), 400)
    loss = lambda w: sum(math.log1p(math.exp(-(z[a] - z[b]) @ w)) for a, b in zip(first, second)) / 400 + 5e-4 * w @ w
    for k in range(3):
        for step in (1e-3, -1e-3):
            other = r.weights.copy()
            other[k] += step
            assert loss(other) > loss(r.weights)
    ranked = sorted(z @ r.weights)
    assert ranked[29] < r.threshold < ranked[30]
