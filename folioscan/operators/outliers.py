"""Outliers among feature rows (doc, id, x, cluster). A document's rows are compared with each other only.

Standard scores, neighbour distances, density clusters, local outlier factors and centroids are DataFrame operations;
the estimators that iterate (isolation forest, power transform, k-means, Hopkins) are numpy functions for one document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.operators.kernels import components, components_of, find_components

SEED = 42
#: Points compared at once by dbscan_2d.
_AT_ONCE = 1 << 18


def matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), dtype=np.float64)


# --- DataFrame operations -----------------------------------------------------------------------------------------------


def unpivot(features: DataFrame) -> DataFrame:
    return features.select("doc", "id", "cluster", F.posexplode("x").alias("f", "v"))


def standardize(features: DataFrame) -> DataFrame:
    """(doc, id, f, z) with the population deviation; a constant feature has scale 1."""
    w = Window.partitionBy("doc", "f")
    s = F.stddev_pop("v").over(w)
    return unpivot(features).withColumn("z", (F.col("v") - F.avg("v").over(w)) / F.when(s == 0, 1.0).otherwise(s)).select("doc", "id", "f", "z")


def _against_all(features: DataFrame, kernel, schema: str, extra: tuple[str, ...] = (), block: int = 2048) -> DataFrame:
    """kernel(ids of a block, its rows, all ids, all rows, values of extra) over every block of every document.

    A document's rows are dealt into blocks of about `block` rows, and its rows go to each block: a document of many
    rows is many tasks, and no pair of rows is ever a row of a table.
    """
    sizes = features.groupBy("doc").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("long").alias("_n"))
    sized = features.select("doc", "id", "x", *extra).join(sizes, "doc")
    left = sized.withColumn("_b", F.pmod(F.xxhash64("id"), "_n")).select(*[F.col(c).alias(c) for c in ("doc", "_b", "id", "x", *extra)])
    right = sized.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).select(*[F.col(c).alias(c) for c in ("doc", "_b", "id", "x")])  # new columns: both sides come from one table

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        a, b = a.sort_values("id"), b.sort_values("id")
        out = kernel(a["id"].to_numpy(), matrix(a.x), b["id"].to_numpy(), matrix(b.x), *[a[e].iloc[0] for e in extra])
        return out.assign(doc=a["doc"].iloc[0])[[c.split()[0] for c in schema.split(", ")]]

    return left.groupBy("doc", "_b").cogroup(right.groupBy("doc", "_b")).applyInPandas(one, schema)


def _row_distances(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = x - v
    return np.sqrt((d * d).sum(axis=1))


def neighbours(features: DataFrame, k: int) -> DataFrame:
    """(doc, a, b, dist, rank) of the k nearest other rows of each row, the smaller id first of equals."""

    def kernel(ids, rows, all_ids, all_rows):
        out = []
        for i, v in zip(ids.tolist(), rows, strict=True):
            d = _row_distances(v, all_rows)
            d[np.searchsorted(all_ids, i)] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(d) - 1)]
            out.append(pd.DataFrame({"a": i, "b": all_ids[near], "dist": d[near], "rank": np.arange(1, len(near) + 1)}))
        return pd.concat(out)

    return _against_all(features, kernel, "doc long, a long, b long, dist double, rank long")


def within(features: DataFrame, eps: DataFrame) -> DataFrame:
    """(doc, a, b) of rows at most the document's eps apart, each with itself included."""

    def kernel(ids, rows, all_ids, all_rows, radius):
        out = []
        for i, v in zip(ids.tolist(), rows, strict=True):
            near = all_ids[_row_distances(v, all_rows) <= radius]
            out.append(pd.DataFrame({"a": np.full(len(near), i), "b": near}))
        return pd.concat(out)

    return _against_all(features.join(eps.select("doc", "eps"), "doc"), kernel, "doc long, a long, b long", ("eps",))


def knn_eps(features: DataFrame, k: int = 4, quantile: float = 0.9) -> DataFrame:
    """The quantile of the distances to the k-th neighbour, oneself being the first."""
    return neighbours(features, k - 1).filter(F.col("rank") == k - 1).groupBy("doc").agg(F.percentile("dist", quantile).alias("eps"))


def core_points(near: DataFrame, min_samples: int = 5) -> DataFrame:
    return near.groupBy("doc", F.col("a").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_samples)


def dbscan(features: DataFrame, min_samples: int = 5) -> DataFrame:
    """(doc, id, label): the smallest core point of the cluster, -1 for noise; a border point takes the smallest label near it."""
    near = within(features, knn_eps(features))
    core = core_points(near, min_samples).select("doc", "id")
    ca, cb = core.toDF("doc", "a"), core.toDF("doc", "b")
    edges = near.filter("a < b").join(ca, ["doc", "a"], "left_semi").join(cb, ["doc", "b"], "left_semi")
    labels = components(core, edges, keys=("doc",), ident="id").toDF("doc", "b", "label")
    border = near.join(labels, ["doc", "b"]).groupBy("doc", F.col("a").alias("id")).agg(F.min("label").alias("near_label"))
    own = labels.toDF("doc", "id", "label")
    return features.select("doc", "id").join(own, ["doc", "id"], "left").join(border, ["doc", "id"], "left").select("doc", "id", F.coalesce("label", "near_label", F.lit(-1)).alias("label"))


def local_outlier_factor(features: DataFrame, k: int = 20) -> DataFrame:
    """Neighbours are clipped to the rows there are; equal rows are kept apart by a small constant."""
    near = neighbours(features, k).drop("rank")
    radius = near.groupBy("doc", F.col("a").alias("b")).agg(F.max("dist").alias("kdist")).toDF("doc", "b", "kdist")
    density = near.join(radius, ["doc", "b"]).groupBy("doc", "a").agg((1 / (F.avg(F.greatest("dist", "kdist")) + 1e-10)).alias("lrd"))
    others = density.toDF("doc", "b", "other")
    return near.join(others, ["doc", "b"]).groupBy("doc", "a").agg(F.avg("other").alias("m")).join(density.toDF("doc", "a", "lrd"), ["doc", "a"]).select("doc", F.col("a").alias("id"), (F.col("m") / F.col("lrd")).alias("lof"))


def nearest_centroids(features: DataFrame) -> DataFrame:
    """Each cluster's nearest other cluster of its document (noise, -1, apart)."""
    c = unpivot(features).filter("cluster >= 0").groupBy("doc", "cluster", "f").agg(F.avg("v").alias("m"))
    o = c.toDF("doc", "other", "f", "n")
    gap = F.sqrt(F.sum((F.col("m") - F.col("n")) * (F.col("m") - F.col("n"))))
    p = c.join(o, ["doc", "f"]).filter("cluster <> other").groupBy("doc", "cluster", "other").agg(gap.alias("dist"))
    return p.groupBy("doc", "cluster").agg(F.min(F.struct("dist", "other")).alias("s")).select("doc", "cluster", F.col("s.other").alias("nearest"), F.col("s.dist").alias("dist"))


def anomalous_features(features: DataFrame, most: int = 3, off: float = 2.5) -> DataFrame:
    """(doc, id, f, z, rank): each row's largest standard scores beyond `off`."""
    z = standardize(features).filter(F.abs("z") > off)
    return z.withColumn("rank", F.row_number().over(Window.partitionBy("doc", "id").orderBy(F.desc(F.abs("z")), "f"))).filter(F.col("rank") <= most)


def separating_features(features: DataFrame, most: int = 3) -> DataFrame:
    """(doc, id, f, pct, rank): the features with the largest shares of a row's squared distance to its cluster's centre.

    A row that is its cluster's centre, as a single one is, has no shares: they are NaN, in order of the features.
    """
    x = unpivot(features)
    s = x.join(x.groupBy("doc", "cluster", "f").agg(F.avg("v").alias("m")), ["doc", "cluster", "f"]).withColumn("sq", (F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))
    w = Window.partitionBy("doc", "id")
    whole = F.sum("sq").over(w)
    t = s.withColumn("pct", F.when(whole == 0, float("nan")).otherwise(100 * F.col("sq") / whole)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("pct"), "f")))
    return t.filter(F.col("rank") <= most).select("doc", "id", "f", "pct", "rank")


def cluster_statistics(features: DataFrame) -> DataFrame:
    """(doc, cluster, f, n, mean, std, all_mean): each cluster's mean and population deviation beside the document's mean."""
    x = unpivot(features)
    c = x.groupBy("doc", "cluster", "f").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return c.join(x.groupBy("doc", "f").agg(F.avg("v").alias("all_mean")), ["doc", "f"]).select("doc", "cluster", "f", "n", "mean", "std", "all_mean")


# --- estimators for one document ------------------------------------------------------------------------------------------


def pairwise(x: np.ndarray) -> np.ndarray:
    """All distances of a document's rows, some rows at a time: the numbers of a row by themselves are never held for all pairs."""
    step = max(1, (1 << 22) // max(1, x.size))
    return np.concatenate([np.sqrt(((x[i : i + step, None, :] - x[None, :, :]) ** 2).sum(axis=2)) for i in range(0, max(1, len(x)), step)])


def yeo_johnson(x: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Each feature transformed by the power of largest likelihood (golden section on [-3, 5]); the searches of all features go on together."""
    n, rows = len(x), np.ascontiguousarray(x.T)

    def transform(v: np.ndarray, p: np.ndarray) -> np.ndarray:
        out, pos, each = np.empty_like(v), v >= 0, np.broadcast_to(p[:, None], v.shape)
        for part, w, q, sign in ((pos, v[pos], each[pos], 1.0), (~pos, -v[~pos], 2 - each[~pos], -1.0)):
            flat = np.abs(q) < 1e-9
            some = np.where(flat, 1.0, q)
            out[part] = sign * np.where(flat, np.log1p(w), ((w + 1) ** some - 1) / some)
        return out

    def likelihood(v: np.ndarray, p: np.ndarray, logs: np.ndarray) -> np.ndarray:
        spread = transform(v, p).var(axis=1)
        some = spread > 0
        return np.where(some, -n / 2 * np.log(np.where(some, spread, 1.0)) + (p - 1) * logs, -np.inf)

    powers, g = np.ones(len(rows)), (5**0.5 - 1) / 2
    open_ = np.flatnonzero(np.ptp(rows, axis=1) != 0)
    a, b = np.full(len(rows), -3.0), np.full(len(rows), 5.0)
    logs = (np.sign(rows) * np.log1p(np.abs(rows))).sum(axis=1)
    searched = open_
    while len(open_):
        v, lo, hi = rows[open_], a[open_], b[open_]
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = likelihood(v, c, logs[open_]) > likelihood(v, d, logs[open_])
        a[open_], b[open_] = np.where(left, lo, c), np.where(left, d, hi)
        open_ = open_[b[open_] - a[open_] > 1e-6]
    powers[searched] = (a[searched] + b[searched]) / 2
    return np.ascontiguousarray(transform(rows, powers).T), powers.tolist()


def transformed_scores(x: np.ndarray) -> np.ndarray:
    """Yeo-Johnson, then standard scores with the population deviation; a constant feature has scale 1, a single row stays as it is."""
    if len(x) < 2:
        return x
    y, _ = yeo_johnson(x)
    s = y.std(axis=0)
    return (y - y.mean(axis=0)) / np.where(np.ptp(x, axis=0) == 0, 1.0, np.where(s == 0, 1.0, s))


def hopkins(x: np.ndarray, seed: int = SEED) -> float:
    """About 0.5 for evenly spread rows, near 1 for clustered ones."""
    n, d = x.shape
    m = int(min(max(10, 0.1 * n), 100, n / 2))
    if m < 1:
        return 0.5
    rng = np.random.default_rng(seed)
    spread = rng.uniform(x.min(axis=0), x.max(axis=0), (m, d))
    u = np.sqrt(((spread[:, None, :] - x[None]) ** 2).sum(axis=2)).min(axis=1).sum()
    chosen = rng.choice(n, m, replace=False)
    own = pairwise(x)[chosen]
    own[np.arange(m), chosen] = np.inf
    w = own.min(axis=1).sum()
    return float(u / (u + w)) if u + w > 0 else 0.5


def kmeans(x: np.ndarray, k: int, seed: int = SEED, rounds: int = 100, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) from spread-out starts; a centre without rows moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        p = d / d.sum() if d.sum() > 0 else None
        centres = np.vstack([centres, x[rng.choice(len(x), p=p)]])
    for _ in range(rounds):
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        labels = d.argmin(axis=1)
        new = np.stack([x[labels == j].mean(axis=0) if (labels == j).any() else x[d.min(axis=1).argmax()] for j in range(k)])
        moved = np.abs(new - centres).max()
        centres = new
        if moved < tolerance:
            break
    return ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1), centres


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    d, kinds = pairwise(x), np.unique(labels)
    if len(kinds) < 2:
        return 0.0
    sums = np.stack([d[:, labels == k].sum(axis=1) for k in kinds], axis=1)
    sizes = np.array([(labels == k).sum() for k in kinds])
    mine = np.searchsorted(kinds, labels)
    i = np.arange(len(x))
    a = sums[i, mine] / np.maximum(sizes[mine] - 1, 1)
    means = sums / sizes
    means[i, mine] = np.inf
    b = means.min(axis=1)
    s = np.where(sizes[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
    return float(s.mean())


def best_kmeans(x: np.ndarray, most: int = 4) -> tuple[np.ndarray, int, float]:
    if len(x) < 3:
        return np.zeros(len(x), np.int64), 1, 0.0
    tried = [(kmeans(x, k)[0], k) for k in range(2, min(most, len(x) - 1) + 1)]
    scored = [(silhouette(x, labels), labels, k) for labels, k in tried]
    score, labels, k = max(scored, key=lambda s: (s[0], -s[2]))
    return labels, k, score


def isolation_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = SEED) -> np.ndarray:
    """2 ** -(mean depth at which random cuts isolate the row / the depth expected); higher is stranger."""
    n = len(x)
    rng = np.random.default_rng(seed)
    m = min(sample, n)
    if m < 2:
        return np.full(n, 0.5)
    expected = lambda k: 0.0 if k < 2 else 1.0 if k == 2 else 2 * (np.log(k - 1) + 0.5772156649) - 2 * (k - 1) / k
    depth = np.zeros(n)
    limit = int(np.ceil(np.log2(m)))

    def grow(inside: np.ndarray, rows: np.ndarray, level: int) -> None:
        here = x[inside]
        lo, hi = here.min(axis=0), here.max(axis=0)
        wide = np.flatnonzero(hi > lo)
        if level >= limit or len(inside) < 2 or not len(wide):
            depth[rows] += level + expected(len(inside))
            return
        f = wide[rng.integers(len(wide))]
        cut = lo[f] + (hi[f] - lo[f]) * rng.random()
        mine, all_ = x[inside, f], x[rows, f]
        grow_to = ((inside[mine < cut], rows[all_ < cut]), (inside[mine >= cut], rows[all_ >= cut]))
        for some, below in grow_to:
            if len(some):
                grow(some, below, level + 1)
            else:
                depth[below] += level + 1

    for _ in range(trees):
        grow(rng.choice(n, m, replace=False), np.arange(n), 0)
    return 2 ** (-depth / trees / expected(m))


def vote(x: np.ndarray, contamination: float = 0.03, min_samples: int = 5) -> dict[str, np.ndarray]:
    """Three detectors and their votes; two agree on an anomaly."""
    n = len(x)
    if n < 2:
        none = np.zeros(n, bool)
        return {"forest": none, "lof": none, "noise": none, "votes": np.zeros(n, np.int64), "is_anomaly": none}
    d = pairwise(x)
    forest = isolation_scores(x)
    k = min(20, n - 1)
    order = np.argsort(d + np.diag(np.full(n, np.inf)), axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(d, order, axis=1)
    radius = near.max(axis=1)
    lrd = 1 / (np.maximum(near, radius[order]).mean(axis=1) + 1e-10)
    lof = lrd[order].mean(axis=1) / lrd
    eps = np.quantile(np.sort(d, axis=1)[:, min(3, n - 1)], 0.9)
    close = d <= eps
    core = close.sum(axis=1) >= min_samples
    noise = ~core & ~close[:, core].any(axis=1)
    flags = {"forest": forest > np.quantile(forest, 1 - contamination), "lof": lof > np.quantile(lof, 1 - contamination), "noise": noise}
    votes = sum(f.astype(np.int64) for f in flags.values())
    return flags | {"votes": votes, "is_anomaly": votes >= 2}


def cluster_analysis(x: np.ndarray, max_k: int = 4, contamination: float = 0.03) -> dict[str, object]:
    """The chain for one document: power transform, standard scores, Hopkins, k-means by silhouette, DBSCAN, vote.

    Fewer than two rows: nothing is transformed, one k-means cluster, all noise, no anomaly.
    """
    n = len(x)
    z = transformed_scores(x)
    if n < 2:
        return {"z": z, "hopkins": 0.5, "kmeans": np.zeros(n, np.int64), "k": 1, "silhouette": 0.0, "dbscan": np.full(n, -1), "dbscan_silhouette": None, "eps": 0.5} | vote(z)
    labels, k, score = best_kmeans(z, max_k)
    d = pairwise(z)
    eps = float(np.quantile(np.sort(d, axis=1)[:, min(3, n - 1)], 0.9))
    dense = density_labels(d, eps, 5)
    kept = dense >= 0
    inner = silhouette(z[kept], dense[kept]) if len(np.unique(dense[kept])) > 1 else None
    return {"z": z, "hopkins": hopkins(z), "kmeans": labels, "k": k, "silhouette": score, "dbscan": dense, "dbscan_silhouette": inner, "eps": eps} | vote(z, contamination)


def density_labels(d: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """DBSCAN over a matrix of distances: labels by smallest core member, -1 for noise."""
    close = d <= eps
    core = close.sum(axis=1) >= min_samples
    at = np.flatnonzero(core)
    label = np.full(len(d), -1)
    label[at] = at[find_components(len(at), list(zip(*np.nonzero(np.triu(close[np.ix_(at, at)], 1)), strict=True)))] if len(at) else []
    for i in np.flatnonzero(~core):
        if close[i, core].any():
            label[i] = label[at[close[i, at]]].min()
    return label


def dbscan_2d(x: np.ndarray, eps: float = 12.0, min_samples: int = 3, group: np.ndarray | None = None) -> np.ndarray:
    """Labels by smallest core member, -1 for noise; for block detection on (centre x * 0.2, centre y).

    Points meet in squares of eps, so only neighbours are compared, some points at a time; memory follows the points.
    group: numbers from 0 of points that are apart.
    """
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    group = np.zeros(n, np.int64) if group is None else group
    cell = np.floor(x / eps).astype(np.int64)
    beside = []  # ranks of the square before, of the square itself and of the one behind it, along each axis
    for k in (0, 1):
        _, ranks = np.unique(np.concatenate([cell[:, k] - 1, cell[:, k], cell[:, k] + 1]), return_inverse=True)
        beside.append(ranks.reshape(3, n))
    wide = 3 * n
    key = lambda p, q: (group * wide + beside[0][p]) * wide + beside[1][q]
    order = np.argsort(key(1, 1), kind="stable")
    have = key(1, 1)[order]
    lo = np.concatenate([np.searchsorted(have, key(p, q), "left") for p in range(3) for q in range(3)])
    counts = np.concatenate([np.searchsorted(have, key(p, q), "right") for p in range(3) for q in range(3)]) - lo
    total = np.concatenate(([0], np.cumsum(counts)))

    def near():
        at = 0
        while at < len(lo):
            stop = max(at + 1, int(np.searchsorted(total, total[at] + _AT_ONCE, "right")) - 1)
            m = np.repeat(np.arange(at, stop), counts[at:stop])
            i, j = m % n, order[lo[m] + np.arange(len(m)) - (total[m] - total[at])]
            ok = ((x[j] - x[i]) ** 2).sum(axis=1) <= eps * eps
            yield i[ok], j[ok]
            at = stop

    core = sum(np.bincount(i, minlength=n) for i, _ in near()) >= min_samples
    up, border = np.arange(n), []
    for i, j in near():
        both = core[i] & core[j] & (i < j)
        up = components_of(n, up[i[both]], up[j[both]])[up]
        one = ~core[i] & core[j]
        border.append((i[one], j[one]))
    label = np.where(core, up, n)
    for i, j in border:
        np.minimum.at(label, i, up[j])
    return np.where(label < n, label, -1)
