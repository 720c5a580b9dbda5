"""Along one axis of a page: islands, line spacing, edges that values share, and the baseline or cell next to a cell.

Rows are cells (keys, ident, x0, y0, x1, y1) and baselines (keys, value). A page's baselines are few: they go to its
cells as one array, or are merged with them into one ordered sequence, so no cell is joined with every baseline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values in points: reach of a value to its label, of a row, of an edge's bucket as a factor.
DISTANCE, ROW, BUCKET = 75.0, 3.0, 0.67


def islands(rows: DataFrame, keys: list[str], value: str, eps: float, ident: str = "box_id", out: str = "island") -> DataFrame:
    """rows with the number of their one-dimensional density cluster: a gap above eps starts another; equal values in order of ident."""
    w = Window.partitionBy(*keys).orderBy(value, ident)
    gap = F.col(value) - F.lag(value).over(w)
    started = rows.withColumn("_s", F.when(gap.isNull() | (gap > eps), 1).otherwise(0))
    return started.withColumn(out, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def line_spacing(cells: DataFrame, keys: list[str], at: str = "y0") -> DataFrame:
    """(keys, at, cells, spacing): lines by their position, with the distance from the line before."""
    lines = cells.groupBy(*keys, at).agg(F.count("*").alias("cells"))
    return lines.withColumn("spacing", F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(at)))


def modal_spacing(cells: DataFrame, keys: list[str], at: str = "y0") -> DataFrame:
    """(keys, spacing, n, mean): the fullest half-point bucket of line spacings, of equals the smaller."""
    c = line_spacing(cells, keys, at).filter("spacing is not null").groupBy(*keys, (F.bround(F.col("spacing") * 2) / 2).alias("_b")).agg(F.count("*").alias("n"), F.avg("spacing").alias("mean"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "_b"))
    return c.withColumn("_r", first).filter("_r = 1").select(*keys, F.col("_b").alias("spacing"), "n", "mean")


def nearest_within(cells: DataFrame, baselines: DataFrame, keys: list[str], edge: Column, reach: float, label: str = "value") -> DataFrame:
    """cells with near (label, distance): the baseline nearest to the edge within reach, of equals the smaller label; null for none."""
    lists = baselines.groupBy(*keys).agg(F.collect_list(F.struct("value", F.col(label).alias("label"))).alias("_lines"))
    off = F.transform(F.filter("_lines", lambda b: F.abs(edge - b["value"]) <= reach), lambda b: F.struct(F.abs(edge - b["value"]).alias("distance"), b["label"].alias("label")))
    return cells.join(lists.toDF(*keys, "_lines"), keys, "left").withColumn("near", F.array_min(off)).drop("_lines")


def first_within(cells: DataFrame, baselines: DataFrame, keys: list[str], edge: Column, reach: float, order: list[Column]) -> DataFrame:
    """cells with first: the first baseline value, in the given order, within reach of the edge, and lines, all values in that order."""
    ranked = F.transform(F.sort_array(F.collect_list(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], "value"))), lambda s: s["value"])
    lists = baselines.groupBy(*keys).agg(ranked.alias("lines"))
    return cells.join(lists.toDF(*keys, "lines"), keys, "left").withColumn("first", F.get(F.filter("lines", lambda x: F.abs(edge - x) <= reach), F.lit(0)))


def next_baseline(cells: DataFrame, baselines: DataFrame, keys: list[str], edge: Column, ident: str = "box_id") -> DataFrame:
    """(keys, ident, next): the first baseline at or beyond the edge, found by merging both into one ordered sequence a page."""
    kind = dict(cells.dtypes)[ident]
    a = cells.select(*keys, edge.alias("at"), ident, F.lit(None).cast("double").alias("value"))
    b = baselines.select(*keys, F.col("value").cast("double").alias("at"), F.lit(None).cast(kind).alias(ident), F.col("value").cast("double").alias("value"))
    w = Window.partitionBy(*keys).orderBy("at", F.col("value").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    return a.unionByName(b).withColumn("next", F.first("value", ignorenulls=True).over(w)).filter(F.col(ident).isNotNull()).select(*keys, ident, "next")


def shared_right_edges(cells: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """cells whose right edge, to about a point and a half, at least `least` cells of the page have, with bucket and n."""
    b = cells.withColumn("bucket", F.bround(F.col("x1") * BUCKET) / BUCKET)
    return b.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "bucket"))).filter(F.col("n") >= least)


def value_of_label(cells: DataFrame, keys: list[str], ident: str = "box_id") -> DataFrame:
    """(keys, ident, value): for each cell the first later one in its row that begins to its right, at most DISTANCE from its end."""
    c = cells.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(ident).alias("_id"), F.col("x0").alias("_x0"), F.col("y0").alias("_y0"), F.floor(F.col("y0") / ROW).alias("_band"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    after = (F.col("_id") > F.col(ident)) & (F.abs(F.col("_y0") - F.col("y0")) <= ROW) & (F.col("_x0") > F.col("x0")) & (F.col("_x0") - F.col("x1") <= DISTANCE)
    own = cells.select(*keys, ident, "x0", "x1", "y0")
    near = own.withColumn("_near", F.explode(F.sequence(F.floor(F.col("y0") / ROW) - 1, F.floor(F.col("y0") / ROW) + 1)))  # a row within reach is in one of three bands
    met = near.join(c, same & (F.col("_near") == F.col("_band")) & after).groupBy(*keys, ident).agg(F.min("_id").alias("value"))
    return own.select(*keys, ident).join(met.toDF(*keys, ident, "value"), [*keys, ident], "left")
