import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscan.llm import elias_fano, near_dedup, suffix_array, tokens, words

P = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "  ", "a  b", " a", "a ", "a\n", "\n a", "a\n\n b", "don't 'll x''s", "<|endoftext|> x<|endoftext|>y <|STARTOFTEXT|>", "ÀÉ ß µ İ ΣΑΣ naïve é x", "a b   c",
       "\t\tq  \n r 12345 ...!!! a_b", "x\xa0y z", None, "日本語 text", "a\vb \v c", "\x00 \x01", "one ́two"]


@pytest.mark.parametrize("name,end", [("word_bpe_49k.json", 1), ("byte_bpe_50k.json", 0), ("byte_bpe_50k.json", None)])
def test_encoder_equals_the_library(name, end, monkeypatch):
    e = tokens.Encoder(P.path(name), end)
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids + e.end.tolist() for t in ODD]
    for texts, ids in ((ODD, want), (ODD[::-1], want[::-1]), (ODD * 3, want * 3), ([], [])):
        flat, n = e.encode(texts)
        assert n.tolist() == [len(x) for x in ids]
        assert flat.tolist() == [i for x in ids for i in x]
    monkeypatch.setattr(tokens, "UNITS", 9)
    for _ in range(4):  # the memory is emptied on the way
        flat, _ = e.encode(ODD)
        assert flat.tolist() == [i for x in want for i in x]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\tabcABC'sé.,!ß日́\x0b12"), max_size=40), max_size=6))
def test_encoder_on_random_texts(texts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = tokens.encoder(P.path(name), 0)
        flat, n = e.encode(texts)
        assert flat.tolist() == [i for t in texts for i in [*e.tokenizer.encode(t, add_special_tokens=False).ids, 0]]


def test_encoder_in_bulk():
    e = tokens.Encoder(P.path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{i}x{j}, Q{j}" for j in range(200)) for i in range(3)]
    flat, n = e.encode(texts)
    assert flat.tolist() == [i for t in texts for i in e.tokenizer.encode(t, add_special_tokens=False).ids]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=700))
def test_elias_fano_round_trip(gaps):
    ends = np.cumsum(np.array(gaps, np.int64))
    total = int(ends[-1]) if gaps else 0
    width, low, high, samples = elias_fano.encode(ends, total)
    s = elias_fano.Sequence(len(gaps), width, low, high, samples)
    assert list(s) == ends.tolist()
    assert [s[i] for i in range(len(gaps))] == ends.tolist()
    assert 8 * (len(low) + len(high)) <= len(gaps) * (3 + max(0, np.log2(max(total, 1) / max(len(gaps), 1)))) + 64


def test_segment_offsets_and_wide_ids():
    ids = np.arange(70_000, dtype=np.uint32)
    s = elias_fano.Segment(elias_fano.write_segment(7, 11, [3, 9], np.array([0, 70_000]), ids))
    assert (s.ordinal, s.start, s[0].tolist(), s[1].tolist() == ids.tolist(), [s.doc_id(0), s.doc_id(1)]) == (7, 11, [], True, [3, 9])


@pytest.mark.parametrize("keys", [[-(1 << 63), (1 << 63) - 1], [None, None], [], [5, 5, 5], [None, -7, 1 << 40], [0]])
def test_segments_of_extreme_doc_ids(keys):
    s = elias_fano.Segment(elias_fano.write_segment(0, 0, keys, np.ones(len(keys), np.int64), np.arange(len(keys), dtype=np.uint32)))
    assert list(s.spans()) == [(k, i, i + 1) for i, k in enumerate(keys)]
    assert [s.doc_id(i) for i in range(len(keys))] == keys


def test_boundaries_take_few_bytes():
    """Ends and doc_ids of a million ids in 5,000 documents: about 10 and 4 bits each, with select directories."""
    rng = np.random.default_rng(3)
    lengths = rng.integers(100, 300, 5000)
    image = elias_fano.write_segment(0, 0, np.sort(rng.choice(50_000, 5000, replace=False)).tolist(), lengths, np.zeros(int(lengths.sum()), np.uint32))
    assert len(image) - 2 * int(lengths.sum()) < 2.2 * 5000


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.booleans())
def test_suffix_array_and_common_prefixes(values, wide):
    t = np.array(values, np.int64) * (300 if wide else 1)
    n = len(t)
    want = sorted(range(n), key=lambda i: values[i:])
    sa = suffix_array.suffix_array(t)
    assert sa.tolist() == want
    if not wide:
        common = suffix_array.permuted_common_prefixes(t.astype(np.uint8), sa, 10)
        for a, b in zip(want, want[1:], strict=False):
            k = 0
            while k < min(n - a, n - b) and values[a + k] == values[b + k]:
                k += 1
            assert common[b] == min(k, 10)


def test_long_runs():
    t = np.concatenate((np.full(3000, 7), [9], np.full(2000, 7))).astype(np.uint8)
    b = t.tobytes()
    assert suffix_array.suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_words(monkeypatch):
    texts = ["Ab-c1 é日! x", None, "", "---", "end", "q" * 5000 + " z"]
    for block in (1 << 20, 1000):  # the second makes words longer than two blocks
        monkeypatch.setattr(words, "BLOCK", block)
        w = words.words_of(pa.array(texts))
        want = [re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()) for t in texts]
        got = [[w.word(i) for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        assert got == want
        assert len(set(w.hashes.tolist())) == len({x for ws in want for x in ws})
    flat = words.words_of(pa.array(["aa bb", "aa"]))
    assert flat.hashes[0] == flat.hashes[2] != flat.hashes[1]


def test_probminhash_estimates_the_probability_jaccard_similarity():
    rng = np.random.default_rng(3)
    element = rng.integers(1, 1 << 48, 300, dtype=np.uint64)
    a, b = element[:240], element[60:]
    wa, wb = rng.integers(1, 5, 240).astype(float), rng.integers(1, 5, 240).astype(float)
    doc = np.repeat([0, 1], 240)
    s = near_dedup.signatures(2, doc, np.concatenate((a, b)), np.concatenate((wa, wb)), 4096)
    of = [dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))]
    want = 0.0
    for d in set(of[0]) & set(of[1]):
        want += 1 / sum(max(of[0].get(e, 0) / of[0][d], of[1].get(e, 0) / of[1][d]) for e in set(of[0]) | set(of[1]))
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_odd_sketches_never_overstate_the_difference():
    rng = np.random.default_rng(4)
    for n, keep in ((50, 40), (900, 500), (20, 0)):
        a = rng.integers(1, 1 << 48, n, dtype=np.uint64)
        b = np.concatenate((a[:keep], rng.integers(1, 1 << 48, n - keep, dtype=np.uint64)))
        s = near_dedup.odd_sketches(2, np.repeat([0, 1], n), np.concatenate((a, b))).view(np.uint8)
        apart = np.unpackbits(s[0] ^ s[1]).sum()
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))
    assert near_dedup.similarity(np.sort(a), np.sort(a)) == 1.0


def test_weighted_sets_count_shingles():
    doc, item, times = near_dedup.weighted_sets(pa.array(["a b c d e a b c d e", "x y", "", "one two three four five"]))
    assert collections.Counter(doc.tolist()) == {0: 5, 1: 1, 3: 1}
    assert sorted(times.tolist()) == [1, 1, 1, 1, 1, 1, 2]


def test_an_idle_encoder_forgets(monkeypatch):
    import time

    monkeypatch.setattr(tokens, "IDLE", 0.05)
    e = tokens.Encoder(P.path("byte_bpe_50k.json"))
    flat, _ = e.encode(["some words"])
    assert len(e.units) > 1
    time.sleep(0.5)
    assert len(e.units) == 1
    again, _ = e.encode(["some words"])
    assert again.tolist() == flat.tolist()
