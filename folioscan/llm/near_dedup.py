"""Near-duplicate detection: ProbMinHash signatures, banding, verification and connected components.

A document is the set of its shingles of five words, taken twice: with all weights 1, and, where shingles repeat, with
weight 1 + ln n for a shingle that occurs n times.
Signatures. Every shingle is a Poisson process whose rate is its weight; each arrival falls on one of 64 registers,
which keeps the shingle that arrived first. A document's processes end as soon as the next arrivals come later than
the latest register (early termination). Two registers agree with the probability Jaccard similarity of the two
documents, which for weights of 1 is the plain one. Banding. 16 bands of 4 registers for the weights of 1: a pair at
plain 0.8 shares a band with probability 0.9998, however often its shingles repeat. The bands of the weighted set come
on top where they differ; alone they would miss pairs whose differing part is repeated text.
Verification. A pair is a link if the plain Jaccard similarity of its shingles, computed from the sets themselves, is
at least 0.8.

No bucket is paired out. In the first round the most popular member of each bucket (the one whose buckets are fullest,
as the original of a group of copies is) is its centre and is compared with the others. The links found so far make
components; a bucket whose members are all in one component is done, as no further link could change the classes. In
a bucket that isn't, the next members outside its largest component become centres (4096, then 65,536, ...) and are
compared with members of other components, pairs judged before excepted; then they leave. Pairs that cannot be links
are left out by an exact bound before their sets are fetched: an odd sketch holds, for each of 2048 bits, the parity of the shingles
that fall on it, so two sketches differ in no more bits than the sets differ in shingles. Before the second round, shingles that
only one document of the unfinished buckets has are counted: what two documents share is at most what either has besides them, so
copies that each have changes of their own are told apart by one number each. So every pair of a bucket is
judged, in one component, or ruled out, while a group of copies costs a comparison or two a member. Texts that are
equal are one document from the start. Components are found by alternating large-star and small-star steps. Rows of
the fullest buckets are salted, centres repeated once a salt, so no task holds a bucket of a third of all documents.

Defined results. Null text: as the empty text. Texts without words: linked to equal texts only. Texts of one to four
words: a single shingle of them all. Very long texts: read whole. Repeated rows and equal texts (by 128 bits of hash;
shingles are compared by 48 bits, inside a pair only): one class. Equal doc_ids with
different texts: classes of their own. Null doc_id: a row without a say in its class's id. Class id: the smallest
doc_id of the class, null if there is none. Empty table: no rows. Extra columns: kept by `distinct`.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import carry, pick, salted, stage, unload
from folioscan.llm.tokens import slices, text_sizes
from folioscan.llm.words import mix, shingles, words_of

SHINGLE, THRESHOLD = 5, 0.8
REGISTERS, BAND = 64, 4
SKETCH = 2048
CHUNK = 1_000_000
#: Texts with candidates, up to which their numbers are broadcast, so that other texts needn't move; beyond, all move once.
BROADCAST = 500_000
_MASK = np.uint64((1 << 48) - 1)


def weighted_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 48-bit shingle, times) of every distinct shingle, in ascending order of text and shingle."""
    w = words_of(texts)
    n_words = np.diff(w.first)
    at = np.arange(max(len(w.hashes) - SHINGLE + 1, 0))
    doc = np.repeat(np.arange(len(n_words)), n_words)
    full = doc[at] == doc[at + SHINGLE - 1] if len(at) else np.zeros(0, bool)
    gram, owner = shingles(w.hashes, SHINGLE)[full], doc[at][full]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(n_words == size)
        if len(short):
            gram = np.concatenate((gram, shingles(w.hashes, size)[w.first[short]]))
            owner = np.concatenate((owner, short))
    keys, times = [], []
    for lo in range(0, max(len(n_words), 1), 1 << 16):  # the text's number takes the upper 16 bits
        part = (owner >= lo) & (owner < lo + (1 << 16))
        key = np.sort(((owner[part] - lo).astype(np.uint64) << np.uint64(48)) | (gram[part] >> np.uint64(16)))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        times.append(np.diff(np.append(first, len(key))))
        keys.append((key[first], lo))
    owners = np.concatenate([(k >> np.uint64(48)).astype(np.int64) + lo for k, lo in keys])
    return owners, np.concatenate([k & _MASK for k, _ in keys]), np.concatenate(times)


def signatures(n: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: an (n, registers) array of elements. Documents without elements keep zeros."""
    soonest = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    seed, time, rate = element.copy(), np.zeros(len(element)), 1.0 / weight
    base = doc * registers
    bits = np.uint64(64 - int(registers).bit_length() + 1)
    while len(element):
        seed = mix(seed + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) * rate
        register = base + (mix(seed ^ np.uint64(0x5851F42D4C957F2D)) >> bits).astype(np.int64)
        np.minimum.at(soonest, register, time)
        won = time == soonest[register]
        winner[register[won]] = element[won]
        latest = soonest.reshape(n, registers).max(axis=1)
        more = time < latest[doc]
        doc, element, seed, time, rate, base = doc[more], element[more], seed[more], time[more], rate[more], base[more]
    return winner.reshape(n, registers)


def bands_of(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key a band, the band's number mixed in."""
    n, m = signature.shape
    parts = signature.reshape(n, m // band, band)
    key = np.broadcast_to(np.arange(m // band, dtype=np.uint64), (n, m // band)).copy()
    for j in range(band):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, j])
    return key.view(np.int64)


def _weights(times: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(times)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending arrays of distinct shingles."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(len(both) - shared, 1)


def candidate_keys(n: int, doc: np.ndarray, element: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, keep): the bands of each document for weights of 1, then those for its weights, and which of them count."""
    plain = bands_of(signatures(n, doc, element, np.ones(len(element))))
    repeats, has = np.zeros(n, bool), np.zeros(n, bool)
    repeats[doc[times > 1]] = True
    has[doc] = True
    part, number = repeats[doc], np.cumsum(repeats) - 1
    weighted = plain.copy()
    weighted[repeats] = bands_of(signatures(int(repeats.sum()), number[doc[part]], element[part], _weights(times[part])))
    return np.concatenate((plain, weighted), axis=1), np.concatenate((np.broadcast_to(has[:, None], plain.shape), weighted != plain), axis=1)


_SIG_DDL = "doc_id long, h long, g long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(text_sizes(batch.column(1)), CHUNK):
            doc, element, times = weighted_sets(batch.column(1).slice(a, b - a))
            keys, keep = candidate_keys(b - a, doc, element, times)
            ends = np.concatenate(([0], np.cumsum(keep.sum(axis=1)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(a, b - a) for c in (0, 2, 3)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[keep]))], names=["doc_id", "h", "g", "bands"]
            )


def odd_sketches(n: int, doc: np.ndarray, element: np.ndarray) -> np.ndarray:
    """(n, SKETCH / 64) integers: for each bit, whether an odd number of the document's elements fall on it."""
    bit = (mix(element.copy()) % np.uint64(SKETCH)).astype(np.int64)
    odd = (np.bincount(doc * SKETCH + bit, minlength=n * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, SKETCH), axis=1, bitorder="little").view(np.int64)


def _pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(text_sizes(batch.column(1)), CHUNK):
            doc, element, _ = weighted_sets(batch.column(1).slice(a, b - a))
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array([element[i:j].tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()), pa.array(np.diff(cut).astype(np.int64)), pa.array(list(odd_sketches(b - a, doc, element)), pa.list_(pa.int64()))],
                names=["id", "items", "size", "sketch"],
            )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims = [similarity(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["centre", "id", "similarity"])


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a set."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1).slice(a, 256)]
            ids = np.repeat(batch.column(0).slice(a, 256).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], names=["id", "shingle"])


def _shared(ids: DataFrame, items: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(id, shared) of those that can have a partner among ids: shared is the number of shingles that any other of them has."""
    own = ids.join(items, "id").mapInArrow(_spell, "id long, shingle long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
    single = own.groupBy("id").agg(F.count("*").alias("own"))
    left = ids.join(sizes, "id").join(single, "id", "left").withColumn("shared", F.col("size") - F.coalesce("own", F.lit(0)))
    return stage(left.filter(F.col("shared") + 1e-6 >= threshold * F.col("size")).select("id", "shared"), "shared")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each component of edges (a, b). Alternating stars; nothing is gathered."""
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    while True:
        # done when every node hangs on one root and no root hangs on another node
        parents = now.groupBy("u").agg(F.count("*").alias("n"))
        if parents.filter("n > 1").isEmpty() and now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        now = stage(small, "stars")


def links(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed, reps, roots): the documents' text hashes, every distinct text with its number and smallest doc_id, and
    (id, root) of every text that a verified link joins to another."""
    hashes = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("g")]
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *hashes)
    signed = stage(texts.mapInArrow(_sign, _SIG_DDL), "signatures")
    # numbers are given once, as the table is written
    reps = stage(signed.groupBy("h", "g").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("text_rep")).withColumn("id", F.monotonically_increasing_id()), "texts")
    rows = reps.select("id", F.explode("bands").alias("key"))
    crowded = stage(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    wide, groups, on = salted(rows, crowded, ["key"], "n", F.col("id"))
    active = stage(wide.join(groups, on).select("key", "_salt", "id", "n"), "bucket-rows")
    wanted = stage(active.select("id").distinct().join(reps.select("id", "h", "g"), "id"), "candidates")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    sets = stage(texts.select("h", "g", "text").join(few, ["h", "g"]).select("id", "text").dropDuplicates(["id"]).mapInArrow(_pack_sets, "id long, items binary, size long, sketch array<long>"), "shingle-sets")
    items, sketches = sets.select("id", "items"), sets.select("id", "size", *[F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH // 64)])
    popular = active.groupBy("id").agg(F.sum("n").alias("popular"))
    salts = F.explode(F.sequence(F.lit(0), "_last")).alias("_salt")
    first = active.join(popular, "id").groupBy("key").agg(F.max(F.struct("popular", (-F.col("id")).alias("minus"))).alias("top"), F.max("_salt").alias("_last")).select("key", (-F.col("top.minus")).alias("centre"), salts)
    pairs = active.join(first, ["key", "_salt"]).filter("id <> centre")
    active = active.drop("n")
    width = SKETCH // 64
    apart = functools.reduce(operator.add, [F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"c{i}"))) for i in range(width)])
    possible = apart * (1 + threshold) <= (F.col("size") + F.col("size_c")) * (1 - threshold) + 1e-6
    of_centre = sketches.select(F.col("id").alias("centre"), F.col("size").alias("size_c"), *[F.col(f"s{i}").alias(f"c{i}") for i in range(width)])
    pairs = pairs.select("centre", "id").distinct().join(of_centre, "centre").join(sketches, "id").filter(possible).select("centre", "id")
    judged, alive, n_centres = None, None, 4096

    def unfinished(active: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows of the buckets whose members aren't all in one component."""
        rooted = active.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        parts = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.max("_salt").alias("_last"))
        largest = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", (-F.col("root")).alias("minus"))).alias("top"), F.max("_last").alias("_last")).filter("parts > 1")
        largest = largest.select("key", (-F.col("top.minus")).alias("big"), "_last", salts)
        return stage(rooted.join(largest, ["key", "_salt"]), "bucket-rows")

    while True:
        pairs = stage(pairs.select(F.least("centre", "id").alias("centre"), F.greatest("centre", "id").alias("id")).distinct(), "pairs")
        carried = pairs.join(items.withColumnsRenamed({"id": "centre", "items": "x"}), "centre").join(items.withColumnRenamed("items", "y"), "id").select("centre", "id", "x", "y")
        now = stage(carried.mapInArrow(_verify, "centre long, id long, similarity double"), "verified")
        judged = now if judged is None else judged.unionByName(now)
        found = judged.filter(F.col("similarity") >= threshold).select(F.col("centre").alias("a"), F.col("id").alias("b"))
        roots = components(found)
        rooted = unfinished(active, roots)
        done = rooted.isEmpty()
        if not done and alive is None:
            alive = _shared(rooted.select("id").distinct(), items, sketches.select("id", "size"), threshold)
            rooted = unfinished(rooted.join(alive, "id", "left_semi").select("key", "_salt", "id"), roots)
            done = rooted.isEmpty()
            sketches, of_centre = sketches.join(alive, "id"), of_centre.join(alive.select(F.col("id").alias("centre"), F.col("shared").alias("shared_c")), "centre")
            enough = F.least("shared", "shared_c") * (1 + threshold) + 1e-6 >= (F.col("size") + F.col("size_c")) * threshold
            possible = enough & possible
        if done:
            return signed.select("doc_id", "h", "g"), reps.drop("bands"), roots
        # each salt gives its share of the centres, so nothing ranks a whole bucket
        order = Window.partitionBy("key", "_salt").orderBy("id")
        chosen = rooted.filter("root <> big").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.ceil(n_centres / (F.col("_last") + 1)))
        centres = chosen.select(F.col("key").alias("_k"), F.explode(F.sequence(F.lit(0), "_last")).alias("_s"), F.col("id").alias("centre"), F.col("root").alias("centre_root")).join(of_centre, "centre")
        pairs = rooted.join(sketches, "id").join(centres, (F.col("key") == F.col("_k")) & (F.col("_salt") == F.col("_s")) & (F.col("root") != F.col("centre_root")) & possible).select("centre", "id").distinct()
        pairs = pairs.select(F.least("centre", "id").alias("centre"), F.greatest("centre", "id").alias("id")).join(judged.select("centre", "id"), ["centre", "id"], "left_anti")
        active = rooted.join(chosen.select("key", "_salt", "id"), ["key", "_salt", "id"], "left_anti").select("key", "_salt", "id")
        n_centres *= 16


def _roots(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(signed, (h, g, id, text_rep, root) of every text)."""
    signed, reps, roots = links(docs, threshold)
    return signed, stage(reps.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "roots")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, and text_rep, the smallest doc_id with an equal text."""
    signed, rooted = _roots(docs, threshold)
    named = rooted.groupBy("root").agg(F.min("text_rep").alias("class_id"))
    return signed.join(rooted.join(named, "root").select("h", "g", "class_id", "text_rep"), ["h", "g"]).select("doc_id", "class_id", "text_rep")


def distinct(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with all its columns (of equal rows any)."""
    _, rooted = _roots(docs, threshold)
    first = F.min(F.struct(F.col("text_rep").isNull(), "text_rep", "h", "g"))
    kept = rooted.groupBy("root").agg(first.alias("m")).select(F.col("m.text_rep").alias("_d"), F.col("m.h").alias("_h"), F.col("m.g").alias("_g"))
    text = F.coalesce("text", F.lit(""))
    whole = carry(docs, "doc_id", "text").withColumn("_x", F.xxhash64(text)).withColumn("_y", F.xxhash64(F.lit(1), text))
    one = whole.join(kept, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_x") == F.col("_h")) & (F.col("_y") == F.col("_g")), "left_semi").dropDuplicates(["doc_id", "_x", "_y"])
    return unload(one, docs)
