"""File-drop ingestion: new payload files become cell rows, once each, with the sources' own parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan.sources import payload


def payload_stream(spark: SparkSession, folder: str, schema: str = payload.PAYLOAD) -> DataFrame:
    """Payloads as they are dropped into a folder."""
    raw = spark.readStream.format("text").option("wholetext", True).load(folder).select("value", payload.stem(F.col("_metadata.file_name")).alias("doc_id"))
    return raw.select("doc_id", F.from_json("value", schema).alias("p")).select("doc_id", "p.*")


def write_epoch(cells: DataFrame, epoch: int, out: str) -> None:
    """The cells as the partition of their epoch: a batch that is repeated after a failure replaces what it had written."""
    cells.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_epoch").parquet(out)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """The cells of all files that are new since the last call go to the Parquet table at out, once each."""
    stream = payload_stream(spark, folder).writeStream.foreachBatch(lambda batch, epoch: write_epoch(payload.cells(batch), epoch, out))
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
