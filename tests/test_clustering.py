"""k-means of all documents at once, beside the kernel for one document."""

import numpy as np
from pyspark.sql import functions as F

from folioscan.operators import clustering, outliers


def _blobs(doc, n, k, rng, d=6):
    centres = rng.normal(0, 10, (k, d))
    return [(doc, i, (centres[i % k] + rng.normal(0, 1, d)).tolist()) for i in range(n)]


def test_inertia_equals_the_kernels(spark):
    rng = np.random.default_rng(3)
    rows = _blobs(1, 300, 3, rng) + _blobs(2, 90, 3, rng) + [(3, i, [1.0, 2.0]) for i in range(5)] + [(4, 0, [0.0]), (4, None, [1.0]), (4, 1, None)]
    df = spark.createDataFrame(rows, "doc long, id long, x array<double>").repartition(5)
    labelled, centres = clustering.kmeans(df, 3)
    labelled = labelled.cache()
    got = {r.doc: r.inertia for r in clustering.inertia(labelled).collect()}
    assert {r.doc: len(r.c) for r in centres.collect()} == {1: 3, 2: 3, 3: 3, 4: 3} and got[3] == 0 and got[4] == 0
    scores = {r.doc: r.silhouette for r in clustering.silhouette(labelled).collect()}
    for doc in (1, 2):
        x = np.array([r[2] for r in rows if r[0] == doc])
        labels, c = outliers.kmeans(x, 3)
        assert got[doc] <= 1.01 * float(((x - c[labels]) ** 2).sum())
        mine = np.array([r.label for r in labelled.filter(F.col("doc") == doc).orderBy("id").collect()])
        assert abs(scores[doc] - outliers.silhouette(x, mine)) < 1e-9
    assert scores[3] == 0 and clustering.kmeans(df.limit(0), 3)[0].count() == 0


def test_a_large_document_is_many_tasks(spark):
    n, k = 100_000, 4
    rows = spark.range(n, numPartitions=16).select(F.lit(1).cast("long").alias("doc"), "id", F.array(*[(F.col("id") % k * (7 + 5 * j) % 29).cast("double") * 3 + F.rand(j) for j in range(8)]).alias("x")).cache()
    labelled, _ = clustering.kmeans(rows, k, rounds=8)
    sizes = labelled.groupBy("label").agg(F.count_distinct(F.col("id") % k).alias("kinds"), F.count("*").alias("n")).collect()
    assert len(sizes) == k and all(r.kinds == 1 and r.n == n // k for r in sizes)


def test_query_ends_where_rows_are_with_their_nearest_mean(spark):
    from folioscan.plans import registry, views

    registry.load()
    sf = "/root/testdata/sf0.001"
    x = {(r.doc, r.id): np.array(r.x) for r in views.features(spark, sf).collect()}
    rows = registry.QUERIES["kmeans_of_documents"](spark, sf).collect()
    assert {(r.doc, r.id) for r in rows} == set(x)
    for doc in {r.doc for r in rows}:
        mine = [r for r in rows if r.doc == doc]
        means = {k: np.mean([x[doc, r.id] for r in mine if r.label == k], axis=0) for k in {r.label for r in mine}}
        for r in mine:
            near = {k: float(np.linalg.norm(x[doc, r.id] - m)) for k, m in means.items()}
            assert abs(near[r.label] - min(near.values())) < 1e-3 and abs(near[r.label] - r.distance) < 1e-3


def test_a_cluster_of_one_row_has_no_shares(spark):
    rows = [(1, 1, [1.0, 2.0], 0), (1, 2, [3.0, 2.0], 0), (1, 3, [9.0, 9.0], 1)]
    got = outliers.separating_features(spark.createDataFrame(rows, "doc long, id long, x array<double>, cluster int")).collect()
    assert sorted((r.id, r.f, str(r.pct), r["rank"]) for r in got) == [(1, 0, "100.0", 1), (1, 1, "0.0", 2), (2, 0, "100.0", 1), (2, 1, "0.0", 2), (3, 0, "nan", 1), (3, 1, "nan", 2)]
