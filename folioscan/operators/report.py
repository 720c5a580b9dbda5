"""Reports: findings gathered per document and written as JSON, Markdown lines or a summary table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_document(findings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per document with its findings as an array of structs, ordered by kind and text."""
    rest = [c for c in findings.columns if c != doc]
    return findings.groupBy(doc).agg(F.count("*").alias("n_findings"), F.sort_array(F.collect_list(F.struct(*rest))).alias("findings"))


def write_json(reports: DataFrame, path: str, doc: str = "doc_id") -> None:
    """A folder per document, named by its slug."""
    from folioscan.functions.text import slugify

    reports.withColumn("slug", slugify(F.col(doc).cast("string"))).write.mode("overwrite").partitionBy("slug").json(path)


def markdown(findings: DataFrame, doc: str = "doc_id", title: str = "text", top: int = 20) -> DataFrame:
    """(doc, line_no, line): a heading, a count, and the `top` findings of highest severity of each document."""
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    w = Window.partitionBy(doc)
    ranked = findings.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(rank, title))).filter(F.col("_k") <= top)
    items = ranked.select(doc, (F.col("_k") + 2).alias("line_no"), F.format_string("- [%s] %s", F.col("severity"), F.left(F.col(title), F.lit(60))).alias("line"))
    heads = ranked.filter("_k = 1").select(doc, F.explode(F.array(F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("# Document "), F.col(doc).cast("string")).alias("line")), F.struct(F.lit(2).alias("line_no"), F.format_string("%d findings", F.col("_n")).alias("line")))).alias("h")).select(doc, "h.*")
    return heads.unionByName(items)


def summary(findings: DataFrame, documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row: documents, documents with findings, findings by severity."""
    per = findings.groupBy(doc).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW")])
    joined = documents.select(doc).join(per, doc, "left")
    return joined.agg(F.count("*").alias("documents"), F.count("high").alias("with_findings"), *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in ("high", "medium", "low")])


def cluster_summary(clustered: DataFrame, doc: str = "doc") -> DataFrame:
    """One row a document of outliers.cluster_analysis rows: samples, clusters of both kinds with their scores, noise, anomalies; write_json stores it."""
    return clustered.groupBy(doc).agg(
        F.count("*").alias("n_samples"), F.round(F.first("hopkins"), 4).alias("hopkins"), F.first("k").alias("kmeans_clusters"), F.round(F.first("silhouette"), 4).alias("kmeans_silhouette"), F.round(F.first("eps"), 4).alias("dbscan_eps"),
        F.count_distinct(F.when(F.col("dbscan") >= 0, F.col("dbscan"))).alias("dbscan_clusters"), F.count_if(F.col("dbscan") < 0).alias("noise"), F.count_if("is_anomaly").alias("anomalies"),
    )


def serialized(value: Column, places: int = 4) -> Column:
    """A number as reports print it: rounded, infinity spelt out."""
    return F.when(value == float("inf"), F.lit("Infinity")).otherwise(F.round(value, places).cast("string"))


def parsed(text: Column, cap: float = 1000.0) -> Column:
    """The reverse, infinity capped."""
    return F.when(text == "Infinity", F.lit(cap)).otherwise(text.try_cast("double"))
