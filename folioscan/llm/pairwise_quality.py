"""Quality scores by Bradley-Terry ranking.

A document's score is linear in features of its text: statistics (lengths, shares of character classes, repetition)
and the relative frequencies of hashed words, word pairs and four-byte strings, GRAMS buckets of each. Preference pairs (a good document over a bad one) are drawn
from labelled rows; weights minimise the logistic loss on the pairs' feature differences with a small ridge. Training
reads at most SAMPLE labelled doc_ids, those with the smallest hash, one text each, and PAIRS pairs; both are
parameters, and at most SAMPLE rows of features reach the driver. The threshold is the quantile of the training scores
at the share of bad labels, midway between its neighbours; the reported score is the logistic function of the
distance to it, so 0.5 is the threshold.

Never features: labels, lang, source, doc_id. Defined results. Null or empty text: the features of an empty text,
scored like any other. Null doc_id: not held out, never trained on. A doc_id with labels of both kinds: left out of
training. A doc_id with several texts: trained on the one of the smallest hash. Labels of one class only, or none:
every score 0.5. Repeated rows: scored each. Empty tables: no rows. Texts of any length are read whole; a statistic
that grows with the text is cut at a bound. Extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import pick
from folioscan.llm.tokens import slices, text_sizes
from folioscan.llm.words import Words, flat, mix, shingles, words_of

SAMPLE, PAIRS, GRAMS = 20_000, 40_000, 64
#: Hashed frequencies count a twentieth of a statistic of the same deviation, so the ridge holds their weights down.
GRAM_SHARE = 0.05
CHUNK = 1_000_000
FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "shout", "bar", "stop", "non_ascii", "distinct_words", "distinct_triples", "echo", "line_words", "short")
_CLASSES = {"upper": range(65, 91), "letter": [*range(65, 91), *range(97, 123)], "digit": range(48, 58), "symbol": b"#*$%&<>", "shout": b"!?", "bar": b"|", "stop": b".,;:", "line": b"\n"}


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[offsets])


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each owner."""
    out = np.zeros(n, np.int64)
    for lo in range(0, n, 1 << 16):
        part = (owner >= lo) & (owner < lo + (1 << 16))
        key = np.sort(((owner[part] - lo).astype(np.uint64) << np.uint64(48)) | (hashes[part] >> np.uint64(16)))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        out[lo : lo + (1 << 16)] += np.bincount((key[new] >> np.uint64(48)).astype(np.int64), minlength=min(1 << 16, n - lo))
    return out


def _hashed(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, GRAMS): the square root of each bucket's share of the owner's hashes."""
    bucket = (mix(hashes.copy()) >> np.uint64(32)).astype(np.int64) % GRAMS
    counts = np.bincount(owner * GRAMS + bucket, minlength=n * GRAMS).reshape(n, GRAMS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def features(texts: pa.Array) -> np.ndarray:
    """(texts, len(FEATURES) + 3 * GRAMS): statistics and hashed frequencies; every entry is bounded whatever the text."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    width = np.diff(offsets)
    four = data.astype(np.uint64)
    four = four[:-3] | four[1:-2] << np.uint64(8) | four[2:-1] << np.uint64(16) | four[3:] << np.uint64(24)
    writer = np.repeat(np.arange(n), width)[: len(four)]
    inside = np.arange(len(four)) + 4 <= offsets[1:][writer]
    w = words_of(texts)
    owner = np.repeat(np.arange(n), np.diff(w.first))
    two = shingles(w.hashes, 2)
    both = owner[: len(two)] == owner[1:] if len(two) else np.zeros(0, bool)
    grams = [_hashed(w.hashes, owner, n), _hashed(two[both], owner[: len(two)][both], n), _hashed(four[inside], writer[inside], n)]
    return np.concatenate((_statistics(data, offsets, w), *grams), axis=1)


def _statistics(data: np.ndarray, offsets: np.ndarray, w: Words) -> np.ndarray:
    """(texts, len(FEATURES))."""
    n = len(offsets) - 1
    count = {}
    for name, members in _CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        count[name] = _per_text(table[data], offsets)
    words = np.diff(w.first)
    owner = np.repeat(np.arange(n), words)
    per_word = np.maximum(words, 1)
    wide = _per_text(data > 127, offsets)
    lengths = np.diff(np.concatenate(([0], np.cumsum(w.ends - w.starts)))[w.first])
    triples = shingles(w.hashes, 3)
    whole = owner[: len(triples)] == owner[2:] if len(triples) else np.zeros(0, bool)
    n_triples = np.bincount(owner[: len(triples)][whole], minlength=n)
    same = np.zeros(len(w.hashes), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
    capped = lambda x, most: np.minimum(x, most)
    return np.stack(
        [
            capped(np.log1p(words), 12),
            capped(lengths / per_word, 30) / 10,
            count["upper"] / np.maximum(count["letter"], 1),
            count["digit"] / np.maximum(lengths, 1),
            capped(count["symbol"] / per_word, 2),
            capped(count["shout"] / per_word, 2),
            capped(count["bar"] / per_word, 2),
            capped(count["stop"] / per_word, 2),
            wide / np.maximum(lengths, 1),
            np.where(words > 0, _distinct(w.hashes, owner, n) / per_word, 1),
            np.where(n_triples > 0, _distinct(triples[whole], owner[: len(triples)][whole], n) / np.maximum(n_triples, 1), 1),
            np.bincount(owner[same], minlength=n) / per_word,
            capped(words / (count["line"] + 1), 200) / 100,
            (words < 20).astype(float),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Ranking:
    """Standardising means and scales, weights and threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> Ranking:
    """Newton steps on the mean logistic loss of feature differences."""
    d = x.shape[1]
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(better) or not len(worse):
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1)
    scale[len(FEATURES) :] /= GRAM_SHARE
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(better, pairs)] - z[rng.choice(worse, pairs)]
    w = np.zeros(d)
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -35, 35)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(d), diff.T @ p / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    ranked = np.sort(z @ w)
    k = len(worse)
    return Ranking(mean, scale, w, float((ranked[k - 1] + ranked[k]) / 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = PAIRS) -> Ranking:
    usable = pick(labels, "doc_id", "quality").filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    agreed = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_q"), F.max("quality").alias("_other")).filter("_q = _other").drop("_other")
    chosen = agreed.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(text_sizes(batch.column(2)), CHUNK):
                x = features(batch.column(2).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "q", "x"])

    # at most `sample` small rows are broadcast and as many rows of features come back
    labelled = pick(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(F.col("_id").cast("long"), F.col("_q").cast("long"), "text")
    one = labelled.groupBy("_id", "_q").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("_id", "_q", "t.text")
    rows = one.mapInArrow(describe, "id long, q long, x array<double>").toArrow().combine_chunks().sort_by("id")
    x = np.array(rows.column("x").combine_chunks().flatten(), np.float64) if rows.num_rows else np.zeros(0)
    return fit(x.reshape(rows.num_rows, len(FEATURES) + 3 * GRAMS), np.array(rows.column("q")) == 1, pairs)


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(ranking)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(text_sizes(batch.column(2)), CHUNK):
                s = shared.value.score(features(batch.column(2).slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int")
