"""Shared pieces of the training-data operators: staging, bindings for array expressions, gapless numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local, a temporary folder is set in its stead; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioscan-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioscan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete what this application has staged; results that weren't written elsewhere can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/folioscan/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, lost executors cost nothing before it."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often and deep body uses it."""
    return F.transform(F.array(value), body)[0]


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name; columns beside them can't clash, whatever their names or letter case."""
    at = docs.toDF(*[f"__fs_{i}" for i in range(len(docs.columns))])
    return at.select(*[F.col(f"__fs_{docs.columns.index(n)}").alias(n) for n in names])


def carry(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the whole row as `__fs_row`; unload() gives the rows back."""
    at = docs.toDF(*[f"__fs_{i}" for i in range(len(docs.columns))])
    row = F.struct(*[F.col(f"__fs_{i}") for i in range(len(docs.columns))])
    return at.select(*[F.col(f"__fs_{docs.columns.index(n)}").alias(n) for n in names], row.alias("__fs_row"))


def unload(carried: DataFrame, docs: DataFrame, replaced: dict[str, Column] | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """The rows as they came in, with some columns replaced and some added.

    An incoming column with the name of an added one, letter case aside, gets "_in" appended until it has none.
    """
    columns = [(replaced or {}).get(n, F.col("__fs_row")[f"__fs_{i}"]).alias(f"__fs_{i}") for i, n in enumerate(docs.columns)]
    added = [c.alias(f"__fs_{len(columns) + k}") for k, c in enumerate((more or {}).values())]
    taken, names = {n.lower() for n in more or {}}, []
    for n in docs.columns:
        while n.lower() in taken:
            n += "_in"
        names.append(n)
    return carried.select(*columns, *added).toDF(*names, *(more or {}))


def salted(rows: DataFrame, groups: DataFrame, on: list[str], size: str, spread: Column, most: int = 4000, each: int = 100) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows, groups, keys): both sides ready for an equi-join on keys in which no key's rows land in one task.

    The `most` groups of the largest `size` get a salt for every `each` of their rows (4096 at most); their rows are
    dealt over the salts by the hash of `spread`, and the group's row is repeated once a salt. The table of salts is
    broadcast: it has `most` rows at most. Any other group is smaller than one part in `most` of all rows. groups
    should be staged, as it is read twice.
    """
    hot = groups.orderBy(F.desc(size), *on).limit(most).filter(F.col(size) >= 2 * each)
    hot = hot.select(*on, F.least(F.lit(4096), F.floor(F.col(size) / each)).cast("int").alias("_salts"))
    wide = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    return wide, groups.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(copies)).drop("_salts"), [*on, "_salt"]


def gapless(df: DataFrame, groups: list[str], order: list[str], out: str, parts: int | None = None) -> DataFrame:
    """Adds `out`: numbers 0, 1, ... within each group, in hash-bucket-major order, without one task per group.

    Each group is dealt into buckets by the hash of the order columns; rows are numbered inside a bucket and the
    bucket's start is the sum of the sizes before it. Rows equal in all order columns are numbered arbitrarily.
    """
    n = parts or max(8, df.sparkSession.sparkContext.defaultParallelism)
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    sizes = dealt.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*groups, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*groups, "_b").orderBy(*order)
    numbered = dealt.withColumn("_r", F.row_number().over(inner) - 1)
    return numbered.join(starts, [*groups, "_b"]).withColumn(out, (F.col("_start") + F.col("_r")).cast("long")).drop("_b", "_r", "_start")


def ordinals(df: DataFrame, order: list[str], sizes: dict[str, str], parts: int | None = None) -> DataFrame:
    """df, staged, with `ordinal` (0, 1, ... in the given order over all rows) and, for each column of sizes, its sum before the row.

    Rows are dealt into ranges of the order columns, numbered inside their range, and shifted by what precedes the
    range: one total per range, of which there are `parts`.
    """
    n = parts or max(8, 2 * df.sparkSession.sparkContext.defaultParallelism)
    ranged = stage(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ordinals")
    inner = Window.partitionBy("_p").orderBy(*order)
    ahead = inner.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_p").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sizes])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sizes])
    local = ranged.withColumn("_r", F.row_number().over(inner) - 1).withColumns({f"_o_{c}": F.coalesce(F.sum(c).over(ahead), F.lit(0)) for c in sizes})
    placed = local.join(F.broadcast(starts), "_p")  # a row per range: `parts` rows at most
    return placed.select(*df.columns, (F.col("_n0") + F.col("_r")).cast("long").alias("ordinal"), *[(F.col(f"_s_{c}") + F.col(f"_o_{c}")).cast("long").alias(out) for c, out in sizes.items()])
