"""The features of the quality score against a plain reading of each."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from folioscan.llm import pairwise_quality as q
from folioscan.llm.words import mix, shingles, words_of


def plain(text):
    b = (text or "").encode()
    lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), b)
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    n, per, total = len(words), max(len(words), 1), sum(map(len, words))
    count = lambda chars: sum(c in chars for c in b)
    letters = sum(chr(c).isalpha() and c < 128 for c in b)
    triples = list(zip(words, words[1:], words[2:], strict=False))
    stats = [
        min(math.log1p(n), 12), min(total / per, 30) / 10, sum(65 <= c <= 90 for c in b) / max(letters, 1), sum(48 <= c <= 57 for c in b) / max(total, 1),
        min(count(b"#*$%&<>") / per, 2), min(count(b"!?") / per, 2), min(count(b"|") / per, 2), min(count(b".,;:") / per, 2), sum(c > 127 for c in b) / max(total, 1),
        len(set(words)) / per if n else 1, len(set(triples)) / len(triples) if triples else 1, sum(x == y for x, y in zip(words, words[1:], strict=False)) / per, min(n / (b.count(b"\n") + 1), 200) / 100, float(n < 20),
    ]
    hash_of = {w: words_of(pa.array([w.decode()])).hashes[0] for w in set(words)}
    one = [hash_of[w] for w in words]
    two = [shingles(np.array(p, np.uint64), 2)[0] for p in zip(one, one[1:], strict=False)]
    four = [np.uint64(int.from_bytes(b[i : i + 4], "little")) for i in range(len(b) - 3)]
    grams = []
    for hashes in (one, two, four):
        buckets = Counter(int(mix(np.array([h], np.uint64))[0] >> np.uint64(32)) % q.GRAMS for h in hashes)
        grams += [math.sqrt(buckets[k] / max(len(hashes), 1)) for k in range(q.GRAMS)]
    return stats + grams


def test_features_equal_a_plain_reading():
    rng = random.Random(6)
    bits = ["the", "The", "word", "été", "日本", "42", "x1", "!", "?", "|", "#", "$", ".", ",", "\n", " ", "  ", "A", "the the", "<>", "\t"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", " ", "abc", "one", "same same same", "long " * 3000]
    got = q.features(pa.array(texts))
    assert got.shape == (len(texts), len(q.FEATURES) + 3 * q.GRAMS)
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, plain(text), atol=1e-12), text
