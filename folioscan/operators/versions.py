"""Two versions of a result side by side: which boxes are the same, changed, added or lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators import matching
from folioscan.operators.lineage import cut

COORDS = ("x0", "y0", "x1", "y1")


def candidates(old: DataFrame, new: DataFrame, keys: list[str], ident: str, tolerance: float) -> DataFrame:
    """(keys, cell, span, score) of old and new boxes whose four coordinates differ by at most tolerance.

    A new box lies in the bin of its corner, an old one in the bins that its corner can reach, four at most: an
    equi-join, each pair once.
    """
    size = 4 * max(tolerance, 0.25)
    reach = lambda c: F.sequence(F.floor((F.col(c) - tolerance) / size), F.floor((F.col(c) + tolerance) / size))
    a = old.select(*keys, F.col(ident).alias("cell"), *COORDS).withColumn("_x", F.explode(reach("x0"))).withColumn("_y", F.explode(reach("y0")))
    b = new.select(*keys, F.col(ident).alias("span"), *[F.col(c).alias(f"_{c}") for c in COORDS]).withColumn("_x", F.floor(F.col("_x0") / size)).withColumn("_y", F.floor(F.col("_y0") / size))
    off = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in COORDS])
    return a.join(b, [*keys, "_x", "_y"]).filter(off <= tolerance).select(*keys, "cell", "span", (1 / (1 + off)).alias("score"))


def compare(old: DataFrame, new: DataFrame, keys: list[str], ident: str, columns: list[str], tolerance: float = 2.0) -> DataFrame:
    """(keys, old, new, status, changed, moved): every box of both versions once.

    Boxes are paired one to one, in order of the old ids, each with the nearest new one that is free. status is same,
    changed (changed: the names of columns that differ, nulls being equal to each other), added or lost; moved is the
    largest difference of coordinates. Keys must not be null.
    """
    old, new = cut(old.select(*keys, ident, *COORDS, *columns)), cut(new.select(*keys, ident, *COORDS, *columns))
    pairs = matching.greedy(candidates(old, new, keys, ident, tolerance), tuple(keys)).select(*keys, "cell", "span", (1 / F.col("score") - 1).alias("moved"))
    a = old.select(*keys, F.col(ident).cast("long").alias("cell"), F.struct(*columns).alias("_a"))
    b = new.select(*keys, F.col(ident).cast("long").alias("span"), F.struct(*columns).alias("_b"))
    both = a.join(pairs, [*keys, "cell"], "left").join(b, [*keys, "span"], "full")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns])) if columns else F.array().cast("array<string>")
    paired = F.col("cell").isNotNull() & F.col("span").isNotNull()
    status = F.when(F.col("cell").isNull(), "added").when(F.col("span").isNull(), "lost").when(F.size(differ) > 0, "changed").otherwise("same")
    return both.select(*keys, F.col("cell").alias("old"), F.col("span").alias("new"), status.alias("status"), F.when(paired, differ).alias("changed"), "moved")


def summary(compared: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: how many boxes are the same, changed, added and lost."""
    return compared.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("same", "changed", "added", "lost")])
