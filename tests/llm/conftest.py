import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """docs from (doc_id, text) pairs, with extra columns whose names clash with others in any letter case."""

    def make(rows, clash=False, key="doc_id"):
        from pyspark.sql import functions as F

        docs = spark.createDataFrame([(k, t) for k, t in rows], f"{key} long, text string").repartition(3)
        if clash:
            for name in ("TEXT", "_row", "row", "block", "h", "_gone", "_stats", "key", "id", "size", "_kept"):
                docs = docs.withColumn("__new", F.lit(f"x-{name}")).toDF(*docs.columns, name)
        return docs

    return make
