"""Findings on label/value pairs: spacing that isn't the page's own, values that meet no edge, and how much their content weighs.

pairs: keys, an id, label, value, spacing (from the label to the value), value_x0, value_x1, and for pairs in one cell
same_cell and cell_x0. Everything is judged per page by windows and one join with the page's edges; a page's edges are
arrays of the few baselines it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as tx

#: Fixed values, in points unless they are counts: spacing tolerance, edge tolerance, width of an edge's bucket as a factor, pairs that make a pattern, values that make an edge, pairs that a page needs.
SPACING, EDGE, BUCKET, PATTERN, SHARED, LEAST = 2.0, 1.5, 0.67, 3, 2, 2
#: Cells that make a baseline; weights from which content is suspicious, and highly so.
BASELINE_COUNT, SUSPICIOUS, HIGHLY = 3, 1.0, 2.5
#: What kinds of content are called in reasons.
CALLED = {"currency": "an amount of money", "number": "a number or id", "date": "a date", "name": "what looks like a name", "text": "plain text"}


def dominant_spacing(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, n, dominant): the mean spacing of the fullest half-point bucket of each page, if it has enough pairs; of equals the smaller."""
    b = pairs.groupBy(*keys, (F.bround(F.col("spacing") * 2) / 2).alias("bucket")).agg(F.count("*").alias("n"), F.avg("spacing").alias("dominant"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "bucket"))
    return b.withColumn("_r", first).filter((F.col("_r") == 1) & (F.col("n") >= PATTERN)).drop("_r")


def _meets(edges: str, at: str) -> Column:
    return F.coalesce(F.exists(edges, lambda e: F.abs(F.col(at) - e) <= EDGE), F.lit(False))


def findings(pairs: DataFrame, keys: list[str], baselines: DataFrame | None = None) -> DataFrame:
    """pairs of pages with a pattern, with classification, deviation, dominant, content_type, weight, severity and reason.

    baselines: keys, side, value, count. On a page with any, values on a left one are consistent and values on a right one
    right_aligned; on other pages values that share their right edge are right_aligned. Then spacing decides. A pair in
    one cell is consistent only where the cell begins on a left baseline. severity is null unless a pair deviates.
    """
    by = Window.partitionBy(*keys)
    edge = F.bround(F.col("value_x1") * BUCKET) / BUCKET
    p = pairs.withColumn("_pairs", F.count("*").over(by)).filter(F.col("_pairs") >= LEAST).withColumn("_shared", F.count("*").over(Window.partitionBy(*keys, edge)))
    p = p.join(dominant_spacing(pairs, keys).select(*keys, "dominant"), keys)
    none = F.array().cast("array<double>")
    if baselines is None:
        p = p.withColumns({"_left": none, "_right": none, "_based": F.lit(False)})
    else:
        side = lambda s: F.collect_list(F.when((F.col("side") == s) & (F.col("count") >= BASELINE_COUNT), F.col("value").cast("double"))).alias(f"_{s}")
        b = baselines.groupBy(*keys).agg(side("left"), side("right"))
        p = p.join(b.toDF(*b.columns), keys, "left").withColumn("_based", F.col("_left").isNotNull())
    left, right = _meets("_left", "value_x0"), F.when(F.col("_based"), _meets("_right", "value_x1")).otherwise(F.col("_shared") >= SHARED)
    one_cell = F.coalesce("same_cell", F.lit(False))
    off = F.abs(F.col("spacing") - F.col("dominant"))
    kind = (
        F.when(one_cell, F.when(_meets("_left", "cell_x0"), "consistent").otherwise("deviation"))
        .when(left, "consistent").when(right, "right_aligned").when(off <= SPACING, "consistent").otherwise("deviation")
    )
    content = tx.content_type(F.col("value"))
    told = p.withColumns({"deviation": off, "classification": kind, "content_type": content}).withColumn("weight", tx.suspicion(F.col("content_type")))
    odd = F.col("classification") == "deviation"
    severity = F.when(odd, F.when(F.col("weight") >= HIGHLY, "HIGH").when(F.col("weight") > SUSPICIOUS, "MEDIUM").otherwise("LOW"))
    called = F.lit(CALLED["text"])
    for k, words in CALLED.items():
        called = F.when(F.col("content_type") == k, words).otherwise(called)
    spaced = F.format_string("spacing %.1f, usual %.1f", "spacing", "dominant")
    why = (
        F.when(one_cell & ~odd, F.format_string("one cell, begins on a left baseline (%.1f)", "cell_x0"))
        .when(one_cell, F.format_string("one cell, begins on no baseline (%.1f): %s", F.col("cell_x0"), called))
        .when(odd, F.format_string("off by %.1f (%s): %s", F.col("deviation"), spaced, called))
        .when(F.col("classification") == "right_aligned", F.concat(F.lit("meets a right edge, "), spaced))
        .when(left, F.concat(F.lit("begins on a left baseline, "), spaced))
        .otherwise(F.concat(F.lit("as usual, "), spaced))
    )
    return told.withColumn("severity", severity).withColumn("reason", why).select(*pairs.columns, "dominant", "deviation", "classification", "content_type", "weight", "severity", "reason")
