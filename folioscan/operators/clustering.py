"""k-means of all documents at once: rows (doc, id, x) are clustered within their document, none of which is one task's work.

Starts are drawn in rounds over all rows (each row with a chance in proportion to its squared distance, twice k a round),
weighted by the rows near them and reduced to k centres, which is work on a few rows a document. Then rows go to their
nearest centre and centres to their rows' mean, one aggregation a round, until no centre of any document moves. Centres
are a row a document; draws follow the hash of the id, so that runs and repeated tasks agree.

Defined results. Equal distances: the smaller label. Fewer different rows than k: some labels have no rows. Null ids or
x: left out. A document's rows may be in any number of partitions. Empty tables: no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.lineage import cut
from folioscan.operators.outliers import SEED, _against_all

#: Distances that a task of the silhouette holds at once.
_AT_ONCE = 1 << 22


def _squared(x: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def assign(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(doc, id, x, label, d) of the nearest centre, d squared; centres: (doc, c) with c an array of centres."""
    best = F.array_min(F.transform("c", lambda c, i: F.struct(_squared(F.col("x"), c).alias("d"), i.alias("label"))))
    near = rows.select("doc", "id", "x").join(centres.select(F.col("doc"), "c"), "doc").withColumn("best", best)
    return near.select("doc", "id", "x", F.col("best.label").alias("label"), F.col("best.d").alias("d"))


def _chance(seed: int, k: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(1 << 30)) / float(1 << 30)


def _weighted(x: np.ndarray, w: np.ndarray, k: int, seed: int, tries: int = 4) -> np.ndarray:
    """k centres of a few weighted rows, the best of some starts."""
    found = None
    for t in range(tries):
        rng = np.random.default_rng(seed + t)
        c = x[[rng.choice(len(x), p=w / w.sum())]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1) * w
            c = np.vstack([c, x[[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else 0]]])
        for _ in range(50):
            near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.stack([np.average(x[near == j], axis=0, weights=w[near == j]) if (near == j).any() else c[j] for j in range(k)])
        cost = float((((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1) * w).sum())
        if found is None or cost < found[0]:
            found = cost, c
    return found[1]


def starts(rows: DataFrame, k: int, seed: int = SEED, rounds: int = 3) -> DataFrame:
    """(doc, c): k centres to begin with."""
    kind = dict(rows.dtypes)["doc"]
    centres = cut(rows.groupBy("doc").agg(F.array(F.min_by("x", F.xxhash64(F.lit(seed), F.col("id")))).alias("c")))
    for r in range(rounds):
        near = cut(assign(rows, centres).select("doc", "id", "x", "d"))
        cost = near.groupBy("doc").agg(F.sum("d").alias("cost")).filter("cost > 0")
        drawn = near.join(cost, "doc").filter(_chance(seed, r) < 2 * k * F.col("d") / F.col("cost")).groupBy("doc").agg(F.sort_array(F.collect_list("x")).alias("more"))
        drawn = drawn.select(F.col("doc").alias("_doc"), "more")
        centres = cut(centres.join(drawn, F.col("doc") == F.col("_doc"), "left").select("doc", F.concat("c", F.coalesce("more", F.array().cast("array<array<double>>"))).alias("c")))
    weights = assign(rows, centres).groupBy("doc", "label").agg(F.count("*").alias("n")).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("n"))
    weights = weights.select(F.col("doc").alias("_doc"), "n")
    weighed = centres.join(weights, F.col("doc") == F.col("_doc")).select("doc", "c", F.transform("c", lambda c, i: F.coalesce(F.element_at("n", i), F.lit(0)).cast("double")).alias("w"))

    def reduce(batches):
        for p in batches:
            out = [_weighted(np.array([list(v) for v in c]), np.array(w), k, seed).tolist() for c, w in zip(p["c"], p["w"], strict=True)]
            yield pd.DataFrame({"doc": p["doc"], "c": out})

    return cut(weighed.mapInPandas(reduce, f"doc {kind}, c array<array<double>>"))


def kmeans(rows: DataFrame, k: int, seed: int = SEED, rounds: int = 50, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """((doc, id, x, label, d), (doc, c)): rows with their labels, and the centres."""
    rows = rows.select("doc", "id", "x").filter("id is not null and x is not null")
    centres = starts(rows, k, seed)
    for _ in range(rounds):
        means = assign(rows, centres).groupBy("doc", "label").agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("x")))).alias("m"))
        means = means.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("label", "m"))).alias("m")).select(F.col("doc").alias("_doc"), "m")
        now = centres.join(means, F.col("doc") == F.col("_doc")).select("doc", F.col("c").alias("was"), F.transform("c", lambda c, i: F.coalesce(F.element_at("m", i), c)).alias("c"))
        now = cut(now)
        moved = now.agg(F.max(F.array_max(F.zip_with("c", "was", lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))))))).first()[0]
        centres = now.select("doc", "c")
        if moved is None or moved < tolerance:
            break
    return assign(rows, centres), centres


def inertia(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("doc").agg(F.sum("d").alias("inertia"))


def silhouette(labelled: DataFrame) -> DataFrame:
    """(doc, silhouette): the mean over all rows, exact; 0 with a single label. Rows go against all rows of their document block by block."""
    packed = labelled.select("doc", "id", F.concat("x", F.array(F.col("label").cast("double"))).alias("x"))
    kind = dict(labelled.dtypes)

    def kernel(ids: np.ndarray, x: np.ndarray, _: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        mine, theirs = x[:, -1].astype(int), y[:, -1].astype(int)
        kinds, sizes = np.unique(theirs, return_counts=True)
        if len(kinds) < 2:
            return pd.DataFrame({"s": [0.0] * len(x)})
        x, y = x[:, :-1], y[:, :-1]
        own, order = np.searchsorted(kinds, mine), np.argsort(theirs, kind="stable")
        y, edge = y[order], np.concatenate(([0], np.cumsum(sizes)[:-1]))
        squares, out, step = (y * y).sum(axis=1), [], max(1, _AT_ONCE // len(y))
        for lo in range(0, len(x), step):
            a = x[lo : lo + step]
            d = np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + squares[None] - 2 * a @ y.T, 0))
            sums, i = np.add.reduceat(d, edge, axis=1), np.arange(len(a))
            o = own[lo : lo + step]
            inside = sums[i, o] / np.maximum(sizes[o] - 1, 1)
            means = sums / sizes
            means[i, o] = np.inf
            outside = means.min(axis=1)
            out.append(np.where(sizes[o] > 1, (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300), 0))
        return pd.DataFrame({"s": np.concatenate(out)})

    return _against_all(packed, kernel, f"doc {kind['doc']}, s double").groupBy("doc").agg(F.avg("s").alias("silhouette"))


def best(rows: DataFrame, most: int = 4, seed: int = SEED) -> DataFrame:
    """(doc, id, label, k, silhouette) of the number of clusters from 2 to `most` with the highest silhouette, the smaller of equals."""
    tried = None
    for k in range(2, most + 1):
        labelled = cut(kmeans(rows, k, seed)[0])
        one = labelled.select("doc", "id", "label").join(silhouette(labelled).toDF("doc", "silhouette"), "doc").withColumn("k", F.lit(k))
        tried = one if tried is None else tried.unionByName(one)
    ranked = tried.groupBy("doc", "id").agg(F.max_by(F.struct("label", "k", "silhouette"), F.struct("silhouette", (-F.col("k")).alias("k"))).alias("b"))
    return ranked.select("doc", "id", "b.*")
