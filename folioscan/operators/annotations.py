"""What the detectors say about each place of a page, gathered: one row a text and box, with the reasons of all of them.

Every detector's rows become (doc_id, page_ix, text, box, reason); `gather` unites any number of them and groups once.
Items without a box keep none and are grouped by their text.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COORDS = ("x0", "y0", "x1", "y1")


def _said(rows: DataFrame, reason: Column) -> DataFrame:
    box = [(F.col(c) if c in rows.columns else F.lit(None)).cast("double").alias(c) for c in COORDS]
    return rows.select("doc_id", "page_ix", F.coalesce("text", F.lit("")).alias("text"), *box, reason.alias("reason"))


def _boxes(rows: DataFrame, cells: DataFrame, ident: str) -> DataFrame:
    """rows with the boxes of their cells."""
    keys = ["doc_id", "page_ix", ident]
    return rows.join(cells.select(*keys, *COORDS).toDF(*keys, *COORDS), keys, "left")


def hidden(found: DataFrame, cells: DataFrame, ident: str = "cell_index") -> DataFrame:
    """Of matching.hidden_text."""
    return _said(_boxes(found, cells, ident), F.concat(F.lit("hidden text: "), F.col("kind")))


def off_column(found: DataFrame, cells: DataFrame, ident: str = "cell_index") -> DataFrame:
    """Of alignment.column_anomalies."""
    return _said(_boxes(found, cells, ident), F.format_string("off the %s edge by %.1f (%s)", "alignment", F.abs("deviation"), "severity"))


def colon(found: DataFrame) -> DataFrame:
    """Of colons.findings: pairs that deviate, at their value (value_x0, value_x1, y0, y1)."""
    odd = found.filter("classification = 'deviation'")
    return _said(odd.select("doc_id", "page_ix", F.col("value").alias("text"), F.col("value_x0").alias("x0"), "y0", F.col("value_x1").alias("x1"), "y1", "reason"), F.concat(F.lit("label and value: "), F.col("reason")))


def rare(profiled: DataFrame) -> DataFrame:
    """Of profile.rare over profile.profile whose items hold text and a box."""
    items = profiled.select("doc_id", "prop", "value", F.explode("items").alias("i")).select("doc_id", F.col("i.page").alias("page_ix"), F.col("i.text").alias("text"), *[F.col(f"i.{c}").alias(c) for c in COORDS], "prop", "value")
    return _said(items, F.concat(F.lit("rare "), F.col("prop"), F.lit(": "), F.col("value")))


def outliers(scored: DataFrame) -> DataFrame:
    """Of outliers.vote: items that two methods or more find odd (doc_id, page_ix, text, box, votes)."""
    return _said(scored.filter("votes >= 2"), F.format_string("odd appearance (%d of 3 methods)", "votes"))


def off_both_sides(found: DataFrame, cells: DataFrame, ident: str = "cell_index") -> DataFrame:
    """Of alignment.vertical_anomalies."""
    return _said(_boxes(found, cells, ident), F.lit("a number on no edge of either side"))


def across(found: DataFrame) -> DataFrame:
    """Of alignment.horizontal_anomalies: runs of cells, at the line that passes through them."""
    return _said(found.withColumn("y0", F.col("line")).withColumn("y1", F.col("line")), F.format_string("a baseline passes through (%s)", "severity"))


def gather(*sources: DataFrame) -> DataFrame:
    """(doc_id, page_ix, text, box, reasons, n): reasons in order, each once; boxes agree to a hundredth of a point."""
    every = functools.reduce(DataFrame.unionByName, sources)
    rounded = every.select("doc_id", "page_ix", "text", *[F.round(c, 2).alias(c) for c in COORDS], "reason")
    return rounded.groupBy("doc_id", "page_ix", "text", *COORDS).agg(F.array_sort(F.collect_set("reason")).alias("reasons")).withColumn("n", F.size("reasons"))
