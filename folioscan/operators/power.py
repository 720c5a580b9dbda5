"""Power transform of all documents at once: every (document, feature) gets the Yeo-Johnson power of largest likelihood.

The search narrows an interval a feature, all of them in one aggregation a round: the likelihood, which has one peak, is
taken at POINTS places of each interval, and the places beside the best one bound the next interval, an eighth of the
last. Rows are unpivoted once; the intervals are a row a (document, feature). The fitted model is such a table too: it
is stored as Parquet and transforms later rows of the same documents by position.

Defined results. A constant feature has power 1 and scale 1 (transformed scores of 0). Null numbers: left out of the
fit, null in the result. Rows of documents without a model, and numbers beyond its features: left out. Empty tables: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators.lineage import cut

#: Powers to search, places at once, rounds (8 / 8 ** 8 is below 1e-6).
LOW, HIGH, POINTS, ROUNDS = -3.0, 5.0, 15, 8


def yeo_johnson(v: Column, p: Column) -> Column:
    up = F.when(F.abs(p) < 1e-9, F.log1p(v)).otherwise((F.pow(v + 1, p) - 1) / p)
    down = F.when(F.abs(p - 2) < 1e-9, -F.log1p(-v)).otherwise(-(F.pow(1 - v, 2 - p) - 1) / (2 - p))
    return F.when(v >= 0, up).otherwise(down)


@dataclass(frozen=True)
class PowerModel:
    """table: doc, powers, means, scales (arrays by feature)."""

    table: DataFrame

    def transform(self, rows: DataFrame) -> DataFrame:
        """(doc, id, x) with x transformed and standardised."""
        m = self.table.select(F.col("doc").alias("_doc"), "powers", "means", "scales")
        score = F.transform(F.slice("x", F.lit(1), F.least(F.size("x"), F.size("powers"))), lambda v, i: (yeo_johnson(v, F.get("powers", i)) - F.get("means", i)) / F.get("scales", i))
        return rows.join(m, F.col("doc") == F.col("_doc")).select("doc", "id", score.alias("x"))

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> PowerModel:
        return PowerModel(spark.read.parquet(path))


def fit(rows: DataFrame) -> PowerModel:
    """The model of rows (doc, id, x)."""
    long = cut(rows.select("doc", F.posexplode("x").alias("f", "v")).filter("v is not null"))
    lean = F.sum(F.signum("v") * F.log1p(F.abs("v")))
    state = cut(long.groupBy("doc", "f").agg(F.count("*").alias("n"), lean.alias("lean"), (F.min("v") == F.max("v")).alias("flat")).withColumns({"a": F.lit(LOW), "b": F.lit(HIGH)}))
    place = lambda i: F.col("a") + (F.col("b") - F.col("a")) * (i / (POINTS + 1))
    for _ in range(ROUNDS):
        at = state.filter("not flat").select(F.col("doc").alias("_doc"), F.col("f").alias("_f"), "a", "b")
        met = long.join(at, (F.col("doc") == F.col("_doc")) & (F.col("f") == F.col("_f")))
        spreads = met.groupBy("doc", "f").agg(*[F.var_pop(yeo_johnson(F.col("v"), place(i))).alias(f"s{i}") for i in range(1, POINTS + 1)])
        spreads = spreads.select(F.col("doc").alias("_doc"), F.col("f").alias("_f"), *[f"s{i}" for i in range(1, POINTS + 1)])
        likely = lambda i: F.when(F.col(f"s{i}") > 0, -F.col("n") / 2 * F.log(f"s{i}") + (place(i) - 1) * F.col("lean")).otherwise(float("-inf"))
        best = F.array_max(F.array(*[F.struct(likely(i).alias("v"), F.lit(-i).alias("i")) for i in range(1, POINTS + 1)]))["i"]
        width = (F.col("b") - F.col("a")) / (POINTS + 1)
        found = state.join(spreads, (F.col("doc") == F.col("_doc")) & (F.col("f") == F.col("_f")), "left").withColumn("i", F.coalesce(-best, F.lit(0)))
        narrow = {"a": F.when(F.col("flat"), F.col("a")).otherwise(F.col("a") + (F.col("i") - 1) * width), "b": F.when(F.col("flat"), F.col("b")).otherwise(F.col("a") + (F.col("i") + 1) * width)}
        state = cut(found.withColumns(narrow).select("doc", "f", "n", "lean", "flat", "a", "b"))
    power = state.select(F.col("doc").alias("_doc"), F.col("f").alias("_f"), F.when(F.col("flat"), 1.0).otherwise((F.col("a") + F.col("b")) / 2).alias("power"), "flat")
    moved = long.join(power, (F.col("doc") == F.col("_doc")) & (F.col("f") == F.col("_f"))).withColumn("y", yeo_johnson(F.col("v"), F.col("power")))
    scale = F.stddev_pop("y")
    fitted = moved.groupBy("doc", "f").agg(F.first("power").alias("power"), F.avg("y").alias("mean"), F.when(F.first("flat") | (scale == 0), 1.0).otherwise(scale).alias("scale"))
    by_feature = F.sort_array(F.collect_list(F.struct("f", "power", "mean", "scale")))
    listed = fitted.groupBy("doc").agg(by_feature.alias("s"))
    whole = lambda name: F.transform(F.sequence(F.lit(0), F.element_at("s", -1)["f"]), lambda i: F.get(F.filter("s", lambda x: x["f"] == i), F.lit(0))[name]).alias(f"{name}s")
    return PowerModel(cut(listed.select("doc", whole("power"), whole("mean"), whole("scale"))))
