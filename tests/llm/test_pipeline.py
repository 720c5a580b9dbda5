import json
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from folioscan.llm import line_dedup, quality_rules
from tests.llm.test_operators import _hits, _line_brute, _near_brute, _rules_brute

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        n = docs.count()
        assert 0 < n <= before
        before = n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "x\ny", "en", "s", 3)], SCHEMA)
    for _, step in corpus_pipeline.STAGES:
        step(spark, docs, SF).collect()
        step(spark, docs.limit(0), SF).collect()


def test_single_lines_between_unlike_neighbours_go(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n {long}\nd"), (3, "one line"), (4, "one line"), (5, f"e\n\nf\n{long}"), (6, long)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("c\nd", 3), 3: ("one line", 8), 4: ("one line", 8), 5: ("e\n\nf", 4)}


def _kept_by_rules(text):
    n, chars, symbols, dup, _, failed = _rules_brute(text)
    w, text = (text or "").split(), text or ""
    lines = [x for x in text.split("\n") if x.strip()]
    stops = {x for ws in quality_rules.STOP_WORDS.values() for x in ws}
    shouts = len(re.findall("[!?]{2,}", text))
    n = max(n, 1)
    return not failed and 2 <= chars / n <= 14 and symbols / n <= 0.1 and shouts / n <= 0.3 and sum(x.lower() in stops for x in w) / n >= 0.02 and dup / max(len(lines), 1) <= 0.5


def test_every_stage_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)] + ["the", "of", "and", "is"] * 200
    prose = lambda n: "\n".join(" ".join(rng.choice(words, 12)) for _ in range(n))
    items = [(f"q{i}", " ".join(f"item{i}x{j}" for j in range(14))) for i in range(4)]
    shared = "a passage that is the same in some of the documents, and is long enough to count as a repeat " * 2
    rows = [(k, prose(8)) for k in range(30)]
    for k in range(4):  # near copies, of one line each, so that line dedup leaves them
        line = rng.choice(words, 120)
        rows += [(80 + 2 * k, " ".join(line)), (81 + 2 * k, " ".join([*line[:60], "other", *line[61:]]))]
    lines = [prose(1) for _ in range(30)]  # two documents that differ in one of 30 lines: what is left of the second is near nothing
    rows += [(90, "\n".join(lines)), (91, "\n".join([*lines[:12], prose(1), *lines[13:]]))]
    rows += [(40 + k, prose(5) + "\n" + items[k][1] + "\n" + prose(2)) for k in range(3)] + [(45, prose(6) + " " + " ".join(items[3][1].split()[:9]))]
    rows += [(50 + k, prose(3) + "\n" + shared + "\n" + prose(3)) for k in range(4)] + [(2, rows[2][1]), (60, rows[2][1])]
    rows += [(70, None), (71, ""), (72, "too short"), (73, "same words the of " * 40), (74, prose(2000)), (None, prose(9)), (75, prose(6) + " !!" * 60)]
    spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(k, t, None if k == 5 else "en", "s", len(t or ""), "x", "y") for k, t in rows], SCHEMA + ", a string, b string").toDF("doc_id", "text", "lang", "source", "n_chars", "TEXT", "Doc_ID")

    def told(df):
        assert df.columns == list(corpus_pipeline.COLUMNS)
        got = df.collect()
        assert all(r.n_chars == len(r.text or "") and (r.lang is None) == (r.doc_id == 5) for r in got)
        return [(r.doc_id, r.text) for r in got], spark.createDataFrame(got, SCHEMA)

    sf = str(tmp_path)
    want = [r for r in rows if _kept_by_rules(r[1])]
    now, docs = told(corpus_pipeline.keep_good(spark, docs, sf))
    assert Counter(now) == Counter(want) and {70, 71, 72, 73, 75}.isdisjoint(k for k, _ in now) and 74 in {k for k, _ in now}
    cut = _line_brute(now, line_dedup.MIN_CHARS, line_dedup.WINDOW)
    want = Counter({(k, t): n for (k, t, lines, gone), n in cut.items() if gone == 0 or gone < lines and lines - gone >= 0.2 * lines})
    now, docs = told(corpus_pipeline.drop_repeated_lines(spark, docs, sf))
    assert Counter(now) == want and sum(shared in t for _, t in now) == 1 and {60, 91}.isdisjoint(k for k, _ in now) and 90 in {k for k, _ in now}
    classes = _near_brute(now)
    now_kept, docs = told(corpus_pipeline.drop_near_duplicates(spark, docs, sf))
    assert {k for k, _ in now_kept if k is not None} == {c for _, c in classes if c is not None} and set(now_kept) <= set(now) and len(now_kept) < len(now)
    hit = {k for k, _, n, _, _ in _hits(now_kept, items) if n}
    now, docs = told(corpus_pipeline.drop_contaminated(spark, docs, sf))
    assert hit == {40, 41, 42} and set(now) == {r for r in now_kept if r[0] not in hit}
    t, pieces, used = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.pack_sequences(spark, docs, sf).collect():
        pieces[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    for k, text in now:
        ids, at = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(pieces.pop(k), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert not pieces
    for spans in used.values():
        assert sum(n for _, n in spans) <= 1024 and [a for a, _ in sorted(spans)] == np.cumsum([0, *[n for _, n in sorted(spans)][:-1]]).tolist()


def test_queries_of_the_package_run_at_the_smallest_scale(spark):
    from folioscan.llm.queries import QUERIES

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    for name in ("op1_suffix_array_dedup", "op7_probminhash_classes", "op10_bradley_terry_quality"):
        assert QUERIES[name](spark, SF).count() == 200


def test_nothing_else_imports_the_package():
    code = "import sys, json; import folioscan.plans.registry as r; r.load(); import folioscan.sources.payload, folioscan.streaming.ingest; print(json.dumps([m for m in sys.modules if m.startswith('folioscan.llm')]))"
    assert json.loads(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) == []


def test_release_deletes_what_was_staged(spark, tmp_path):
    import os

    from folioscan.llm import common

    common.stage(spark.range(3).toDF("x"), "t")
    folder = f"{common.shared_dir(spark)}/folioscan/{spark.sparkContext.applicationId}".removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    common.release(spark)
    assert not os.path.exists(folder)
