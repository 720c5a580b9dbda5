"""Stored results that a later run goes on from.

A result belongs to a fingerprint: the SHA-256 of a document's payload and of the parameters. A run computes only
documents whose fingerprint isn't marked as done, writes their rows to a partition of its own, and then their marks
(also of documents without rows). Both writes replace the run's own partition only (dynamic partition overwrite), so a
run that died is simply repeated; rows that have no mark of their run are never read. Rows of old payloads and parameters stay,
unread, until `vacuum`.

Defined results. Documents are told apart by doc_id; equal rows count once, and of different payloads of one doc_id each
has its own results. A null doc_id is a document of its own. Empty tables: nothing is computed or written.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators.lineage import cut


def fingerprinted(payloads: DataFrame, params: dict) -> DataFrame:
    """payloads with fingerprint; columns go in by name, in order of names."""
    names = sorted(payloads.columns)
    body = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"})
    return payloads.withColumn("fingerprint", F.sha2(F.concat(F.lit(json.dumps(params, sort_keys=True, default=str) + "\n"), body), 256))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def done(spark: SparkSession, path: str) -> DataFrame | None:
    """(doc_id, fingerprint, run) of what is stored, None for a new store."""
    return spark.read.parquet(f"{path}/done") if _exists(spark, f"{path}/done") else None


def pending(payloads: DataFrame, params: dict, path: str) -> DataFrame:
    """payloads without a stored result for these parameters, with their fingerprint."""
    todo = fingerprinted(payloads, params).dropDuplicates(["fingerprint"])
    known = done(payloads.sparkSession, path)
    return todo if known is None else todo.join(known.select("fingerprint"), "fingerprint", "left_anti").select(*payloads.columns, "fingerprint")


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def resume(payloads: DataFrame, params: dict, compute: Callable[[DataFrame], DataFrame], path: str) -> int:
    """Compute and store what is missing; how many documents that were. compute gives rows with doc_id and fingerprint kept."""
    todo = cut(pending(payloads, params, path))
    found = todo.agg(F.count("*").alias("n"), F.sum(F.xxhash64("fingerprint").cast("decimal(38,0)")).alias("b")).first()
    if not found.n:
        return 0
    run = F.lit(f"{found.n}-{int(found.b) % (1 << 64):x}")  # the same documents make the same run
    _write(compute(todo).withColumn("run", run), f"{path}/rows")
    _write(todo.select("doc_id", "fingerprint").withColumn("run", run), f"{path}/done")
    return found.n


def current(payloads: DataFrame, params: dict, path: str) -> DataFrame | None:
    """The stored rows of these payloads and parameters, without fingerprint and run."""
    spark = payloads.sparkSession
    marks = done(spark, path)
    if marks is None:
        return None
    wanted = fingerprinted(payloads, params).select("fingerprint").distinct()
    mine = marks.select("fingerprint", "run").join(wanted, "fingerprint", "left_semi").dropDuplicates(["fingerprint"])
    return spark.read.parquet(f"{path}/rows").join(mine, ["fingerprint", "run"], "left_semi").drop("fingerprint", "run")


def vacuum(payloads: DataFrame, params: dict, path: str, target: str) -> None:
    """A new store in target with only what `current` reads."""
    spark = payloads.sparkSession
    wanted = fingerprinted(payloads, params).select("fingerprint").distinct()
    marks = done(spark, path).join(wanted, "fingerprint", "left_semi").dropDuplicates(["fingerprint"])
    _write(spark.read.parquet(f"{path}/rows").join(marks.select("fingerprint", "run"), ["fingerprint", "run"], "left_semi"), f"{target}/rows")
    _write(marks, f"{target}/done")
