"""Queries over feature rows: standard scores, neighbours, densities, clusters, votes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators import appearance, clustering, explain, outliers, power
from folioscan.plans import views as v
from folioscan.plans.registry import query

_LONG = "long_rows as (select doc, id, cluster, generate_subscripts(x, 1) - 1 as f, unnest(x) as v from features)"
_DIST = """dist as (select a.doc, a.id as a, b.id as b, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) as dist from features a join features b on a.doc = b.doc)"""
_EPS = "eps as (select doc, quantile_cont(dist, 0.9) as eps from (select *, row_number() over (partition by doc, a order by dist, b) as k from dist) where k = 4 group by 1)"
_CORE = "core as (select doc, a as id, count(*) as n from dist join eps using (doc) where dist <= eps group by 1, 2 having count(*) >= 5)"


@query(f"with {v.FEATURES}, {_LONG}, m as (select doc, f, avg(v) as m, stddev_pop(v) as s from long_rows group by 1, 2) select doc, id, cast(f as integer) as f, round((v - m) / case when s = 0 then 1 else s end, 6) as z from long_rows join m using (doc, f)")
def standardize(spark, d):
    return outliers.standardize(v.features(spark, d)).select("doc", "id", "f", F.round("z", 6).alias("z"))


@query(f"with {v.FEATURES}, {_LONG}, m as (select doc, f, avg(v) as m, stddev_pop(v) as s from long_rows group by 1, 2), z as (select doc, id, f, (v - m) / case when s = 0 then 1 else s end as z from long_rows join m using (doc, f)) select doc, id, cast(f as integer) as f, round(z, 6) as z, rank from (select *, row_number() over (partition by doc, id order by abs(z) desc, f) as rank from z where abs(z) > 2.5) where rank <= 3")
def top_features(spark, d):
    """A row's three largest standard scores beyond 2.5."""
    return outliers.anomalous_features(v.features(spark, d)).select("doc", "id", "f", F.round("z", 6).alias("z"), "rank")


@query(f"with {v.FEATURES}, {_DIST}, {_EPS} select doc, round(eps, 6) as eps from eps")
def knn_eps(spark, d):
    return outliers.knn_eps(v.features(spark, d)).select("doc", F.round("eps", 6).alias("eps"))


@query(f"with {v.FEATURES}, {_DIST}, {_EPS}, {_CORE} select f.doc, f.id, core.id is not null as is_core from features f left join core on f.doc = core.doc and f.id = core.id")
def dbscan_core_flags(spark, d):
    f = v.features(spark, d)
    core = outliers.core_points(outliers.within(f, outliers.knn_eps(f))).withColumn("is_core", F.lit(True))
    return f.select("doc", "id").join(core.select("doc", "id", "is_core"), ["doc", "id"], "left").fillna(False, ["is_core"])


@query(f"""with recursive {v.FEATURES}, {_DIST}, {_EPS}, {_CORE}, e as (select d.doc, d.a, d.b from dist d join eps using (doc) join core c on c.doc = d.doc and c.id = d.a join core k on k.doc = d.doc and k.id = d.b where dist <= eps),
r as (select doc, id, id as seen from core union select r.doc, r.id, e.b from r join e on r.doc = e.doc and r.seen = e.a), lab as (select doc, id, min(seen) as label from r group by 1, 2),
edge as (select d.doc, d.a as id, min(l.label) as label from dist d join eps using (doc) join lab l on l.doc = d.doc and l.id = d.b where dist <= eps group by 1, 2)
select f.doc, f.id, coalesce(lab.label, edge.label, -1) as label from features f left join lab on lab.doc = f.doc and lab.id = f.id left join edge on edge.doc = f.doc and edge.id = f.id""")
def dbscan_components(spark, d):
    """Density clusters, labelled by their smallest core point; -1 for noise."""
    return outliers.dbscan(v.features(spark, d))


@query(f"""with {v.FEATURES}, {_DIST}, nn as (select doc, a, b, dist, row_number() over (partition by doc, a order by dist, b) as k from dist where a <> b), kd as (select doc, a, max(dist) as kdist from nn where k <= 20 group by 1, 2),
lrd as (select n.doc, n.a, 1 / (avg(greatest(n.dist, kd.kdist)) + 1e-10) as lrd from nn n join kd on kd.doc = n.doc and kd.a = n.b where k <= 20 group by 1, 2)
select n.doc, n.a as id, round(avg(o.lrd) / any_value(m.lrd), 6) as lof from nn n join lrd o on o.doc = n.doc and o.a = n.b join lrd m on m.doc = n.doc and m.a = n.a where k <= 20 group by 1, 2""")
def lof_scores(spark, d):
    return outliers.local_outlier_factor(v.features(spark, d)).select("doc", "id", F.round("lof", 6).alias("lof"))


@query(f"with {v.FEATURES}, {_LONG}, c as (select doc, cluster, f, avg(v) as mean, stddev_pop(v) as std, count(*) as n from long_rows group by 1, 2, 3), g as (select doc, f, avg(v) as all_mean from long_rows group by 1, 2) select doc, cluster, cast(f as integer) as f, n, round(mean, 6) as mean, round(std, 6) as std, round(all_mean, 6) as all_mean from c join g using (doc, f)")
def cluster_statistics(spark, d):
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "std", "all_mean")]
    return outliers.cluster_statistics(v.features(spark, d)).select("doc", "cluster", "f", "n", *rounded)


_CENTRES = "c as (select doc, cluster, f, avg(v) as m from long_rows group by 1, 2, 3)"


@query(f"with {v.FEATURES}, {_LONG}, {_CENTRES}, p as (select a.doc, a.cluster, b.cluster as other, sqrt(sum((a.m - b.m) * (a.m - b.m))) as dist from c a join c b on a.doc = b.doc and a.f = b.f and a.cluster <> b.cluster group by 1, 2, 3) select doc, cluster, other as nearest, round(dist, 6) as dist from p qualify row_number() over (partition by doc, cluster order by dist, other) = 1")
def nearest_centroid(spark, d):
    return outliers.nearest_centroids(v.features(spark, d)).select("doc", "cluster", "nearest", F.round("dist", 6).alias("dist"))


@query(f"""with {v.FEATURES}, {_LONG}, {_CENTRES}, s as (select l.doc, l.id, l.f, (l.v - c.m) * (l.v - c.m) as sq from long_rows l join c on l.doc = c.doc and l.cluster = c.cluster and l.f = c.f),
t as (select *, 100 * sq / sum(sq) over (partition by doc, id) as pct from s) select doc, id, cast(f as integer) as f, round(pct, 6) as pct, rank from (select *, row_number() over (partition by doc, id order by pct desc, f) as rank from t) where rank <= 3""")
def feature_importance(spark, d):
    """Shares of a row's squared distance to its cluster's centre; the three largest."""
    return outliers.separating_features(v.features(spark, d)).withColumn("pct", F.round("pct", 6))


_SIGNS = "case t.f " + " ".join(f"when {k} then case when m > a then '{hi}' else '{lo}' end" for k, (_, hi, lo, _) in enumerate(explain.WORDS[n] for n in explain.NAMES)) + " end"
_TITLES = "case t.f " + " ".join(f"when {k} then '{explain.WORDS[n][0]}'" for k, n in enumerate(explain.NAMES)) + " end"


@query(f"""with {v.FEATURES}, {_LONG}, {_CENTRES}, g as (select doc, f, avg(v) as a from long_rows group by 1, 2), t as (select c.doc, c.cluster, c.f, c.m, g.a from c join g on c.doc = g.doc and c.f = g.f)
select doc, cluster, cast(f as integer) as f, {_TITLES} as name, {_SIGNS} as finding from t""")
def feature_explanations(spark, d):
    """For each cluster and each number in which direction it is off the document; the first 26 stand for the features that have words."""
    x = outliers.unpivot(v.features(spark, d))
    j = x.groupBy("doc", "cluster", "f").agg(F.avg("v").alias("m")).join(x.groupBy("doc", "f").agg(F.avg("v").alias("a")), ["doc", "f"])
    name = F.coalesce(F.get(F.array(*[F.lit(n) for n in explain.NAMES]), F.col("f")), F.concat(F.lit("number_"), F.col("f").cast("string")))
    told = explain.explain(j.withColumn("feature", name), "feature", F.col("m") > F.col("a"))
    return told.select("doc", "cluster", "f", "name", "finding")


@query()
def cluster_analysis(spark, d):
    """The whole chain over each document's rows: transform, standard scores, Hopkins, k-means, DBSCAN, vote."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        r = outliers.cluster_analysis(outliers.matrix(p.x))
        return p[["doc", "id"]].assign(**{k: r[k] for k in ("hopkins", "kmeans", "k", "silhouette", "dbscan", "eps", "votes", "is_anomaly")})

    return _per_document(v.features(spark, d), kernel, "doc long, id long, hopkins double, kmeans long, k long, silhouette double, dbscan long, eps double, votes long, is_anomaly boolean")


def _per_document(f: DataFrame, kernel, schema: str) -> DataFrame:
    # few bytes, much work: without a number of their own the partitions would be joined by size until few tasks do it all
    tasks = int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return f.repartition(tasks, "doc").groupBy("doc").applyInPandas(kernel, schema)


@query()
def isolation_scores(spark, d):
    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        return p[["doc", "id"]].assign(score=outliers.isolation_scores(outliers.matrix(p.x)))

    return _per_document(v.features(spark, d), kernel, "doc long, id long, score double")


@query()
def yeo_johnson(spark, d):
    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        y, lambdas = outliers.yeo_johnson(outliers.matrix(p.x))
        return p[["doc", "id"]].assign(y=list(y), lambdas=[lambdas] * len(p))

    return _per_document(v.features(spark, d), kernel, "doc long, id long, y array<double>, lambdas array<double>")


@query()
def hopkins(spark, d):
    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc": [p.doc.iloc[0]], "hopkins": [outliers.hopkins(outliers.matrix(p.sort_values("id").x))]})

    return _per_document(v.features(spark, d), kernel, "doc long, hopkins double")


@query()
def kmeans_labels(spark, d):
    """k-means for k = 2 to 4; the k of the largest silhouette."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        labels, k, score = outliers.best_kmeans(outliers.matrix(p.x))
        return p[["doc", "id"]].assign(label=labels, k=k, silhouette=score)

    return _per_document(v.features(spark, d), kernel, "doc long, id long, label long, k long, silhouette double")


@query()
def ensemble_vote(spark, d):
    """Rows that at least two of isolation forest, local outlier factor and density noise find unusual, on transformed standard scores."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        return p[["doc", "id"]].assign(**outliers.vote(outliers.transformed_scores(outliers.matrix(p.x))))

    return _per_document(v.features(spark, d), kernel, "doc long, id long, forest boolean, lof boolean, noise boolean, votes long, is_anomaly boolean")


@query()
def raster_statistics(spark, d):
    """The 26 appearance features of small rasters (8 x 8 grey pixels made of embeddings)."""
    grey = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + 128 * x.cast("double"))))
    t = v.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).cast("long").alias("doc"), F.col("vec_id").alias("id"), grey.alias("pixels"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    return appearance.features(t, ["doc", "id"])


@query()
def kmeans_of_documents(spark, d):
    """Three clusters of every document's rows, by rounds over all documents at once, with each row's distance to its centre."""
    labelled, _ = clustering.kmeans(v.features(spark, d), 3)
    return labelled.select("doc", "id", "label", F.sqrt("d").alias("distance"))


@query()
def power_scores(spark, d):
    """Every number of the feature rows transformed by its document's fitted power and standardised."""
    f = v.features(spark, d)
    return power.fit(f).transform(f).select("doc", "id", F.posexplode("x").alias("f", "z"))
