"""The alignment pipeline of a page: cells to blocks to alignment to anomalies. Keys of a page come first everywhere."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folioscan.functions import text as tx
from folioscan.operators import baselines, blocks, kernels, spatial
from folioscan.operators.lineage import cut


@dataclass(frozen=True)
class Thresholds:
    """Named limits of the pipeline, in points unless they are shares."""

    v_eps: float = 12.0
    h_eps: float = 40.0
    passes: int = 3
    baseline: float = 5.0
    aligned: float = 0.70
    center: float = 0.30
    high: float = 10.0
    medium: float = 5.0
    strong: float = 0.90
    min_confidence: float = 0.70
    intrusion_gap: float = 14.0
    intrusion_count: int = 4
    intrusion_chars: int = 5
    interior_margin: float = 0.6
    interior_low: float = 0.3
    interior_high: float = 0.7
    gap_below: float = 4.0
    min_offset: float = 2.5
    max_offset_difference: float = 1.75
    min_height: float = 2.0


def assign_blocks(cells: DataFrame, keys: list[str], ident: str, t: Thresholds = Thresholds(), compat: bool = False) -> DataFrame:
    """cells with block_id; cells that no block holds are left out, and with compat a noise block comes twice.

    Where cells have table_id and column_id, the columns of a table stay in blocks of their own.
    """
    tabled = {"table_id", "column_id"} <= set(cells.columns)
    schema = StructType([*cells.schema.fields, StructField("block_id", IntegerType())])

    everything = cells.columns
    names = [c for c in everything if c not in keys]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        page, rows = kernels.rows_of(batch.column("rows"))
        order = pc.sort_indices(pa.table({"page": page, "ident": rows[ident]}), sort_keys=[("page", "ascending"), ("ident", "ascending")])
        page, rows = page[order.to_numpy()], {c: x.take(order) for c, x in rows.items()}
        x0, y0, x1, y1 = (rows[c].to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "y0", "x1", "y1"))
        cx, cy = ((x0 + x1) / 2).tolist(), ((y0 + y1) / 2).tolist()
        tables = list(zip(rows["table_id"].to_pylist(), rows["column_id"].to_pylist(), strict=True)) if tabled else None
        taken, number = [], []
        ends = [0, *(np.flatnonzero(np.diff(page)) + 1).tolist(), len(page)]
        for at, stop in zip(ends, ends[1:], strict=False):
            columns = [None if pd.isna(a) or pd.isna(b) else (a, b) for a, b in tables[at:stop]] if tabled else None
            for k, block in enumerate(kernels.split_iteratively(cx[at:stop], cy[at:stop], t.v_eps, t.h_eps, t.passes, compat, columns)):
                taken += [at + i for i in block]
                number += [k] * len(block)
        of = pa.array(taken, pa.int64())
        arrays = dict(zip(keys, (batch.column(k).take(pa.array(page)).take(of) for k in keys), strict=True)) | {c: rows[c].take(of) for c in names}
        return pa.RecordBatch.from_arrays([*(arrays[c] for c in everything), pa.array(number, pa.int32())], [*everything, "block_id"])

    return kernels.many_pages(kernels.packed_pages(cells, keys), kernel, schema)


def block_alignment(blocked: DataFrame, keys: list[str], ident: str, t: Thresholds = Thresholds()) -> DataFrame:
    """Type (right before left before center before mixed), modal baseline and confidence of each block."""
    # one aggregation: a null edge, when most frequent, comes before others as the least does
    none = F.lit(float("-inf"))
    edges = [("left", "x0"), ("right", "x1")]
    grouped = blocked.groupBy(*keys, "block_id").agg(
        F.count("*").alias("cells"), *[F.mode(F.coalesce(F.bround(e).cast("double") + 0.0, none), True).alias(f"_mode_{s}") for s, e in edges], *[F.collect_list(e).alias(f"_all_{s}") for s, e in edges],
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    based = grouped.withColumns({f"{s}_base": F.when(F.col(f"_mode_{s}") != none, F.col(f"_mode_{s}")) for s, _ in edges})

    def share(side: str) -> Column:
        base, met = F.col(f"{side}_base"), F.size(F.filter(f"_all_{side}", lambda x: F.abs(x - F.col(f"{side}_base")) <= t.baseline))
        return F.when(base.isNotNull(), met.cast("double") / F.size(f"_all_{side}"))

    shares = based.withColumns({f"{s}_share": share(s) for s, _ in edges})
    kind = F.when(F.col("right_share") >= t.aligned, "right").when(F.col("left_share") >= t.aligned, "left").when((F.col("left_share") < t.center) & (F.col("right_share") < t.center), "center").otherwise("mixed")
    typed = shares.withColumn("alignment", kind)
    confidence = F.when(F.col("alignment") == "right", F.col("right_share")).when(F.col("alignment") == "left", F.col("left_share")).otherwise(0.0)
    baseline = F.when(F.col("alignment") == "right", F.col("right_base")).when(F.col("alignment") == "left", F.col("left_base"))
    return typed.select(*keys, "block_id", "cells", "alignment", baseline.alias("baseline"), F.round(confidence, 3).alias("confidence"), "x0", "y0", "x1", "y1")


def column_anomalies(blocked: DataFrame, aligned: DataFrame, keys: list[str], ident: str, t: Thresholds = Thresholds()) -> DataFrame:
    """Cells off their block's baseline, with the block's severity."""
    sides = aligned.filter(F.col("alignment").isin("left", "right") & (F.col("confidence") >= t.min_confidence)).select(*keys, "block_id", "alignment", "baseline", "confidence")
    edge = F.when(F.col("alignment") == "left", F.col("x0")).otherwise(F.col("x1"))
    off = blocked.join(sides, [*keys, "block_id"]).withColumn("deviation", F.round(edge - F.col("baseline"), 2)).filter(F.abs("deviation") > t.baseline)
    by = Window.partitionBy(*keys, "block_id")
    n, largest = F.count("*").over(by), F.max(F.abs("deviation")).over(by)
    severity = F.when((largest > t.high) | ((n >= 2) & (F.col("confidence") >= t.strong)), "HIGH").when(largest > t.medium, "MEDIUM").otherwise("LOW")
    return off.select(*keys, "block_id", ident, "text", "alignment", F.col("baseline").alias("expected"), "deviation", severity.alias("severity"))


def vertical_anomalies(anomalies: DataFrame, baselines: DataFrame, keys: list[str]) -> DataFrame:
    """Numeric cells among them that don't meet a baseline of the other side either (left_edges, right_edges arrays)."""
    numeric = anomalies.filter(tx.is_numeric_value(F.col("text"))).join(baselines, keys, "left")
    other = F.when(F.col("alignment") == "left", F.col("right_edges")).otherwise(F.col("left_edges"))
    met = F.exists(other, lambda b: F.abs(F.col("expected") + F.col("deviation") - b) < 1.5)
    return numeric.filter(~F.coalesce(met, F.lit(False))).drop("left_edges", "right_edges")


def horizontal_anomalies(cells: DataFrame, keys: list[str], ident: str, t: Thresholds = Thresholds(), found: DataFrame | None = None) -> DataFrame:
    """Runs of cells through whose middle a baseline of other cells passes.

    found: baselines (side, value, count); without them the page's own. A cell counts for the first bottom baseline, in
    order of value, that many cells have, that lies in its interior and about as far from its top as from its bottom,
    unless the next baseline below the cell is close.
    """
    found = baselines.detect(cells, keys) if found is None else found
    values = F.sort_array(F.collect_list(F.struct("value", "count"))).alias("_lines")
    lines = found.filter("side = 'bottom'").groupBy(*keys).agg(values)
    y0, y1 = F.col("y0"), F.col("y1")
    height = y1 - y0

    def fits(x):
        top, bottom = x["value"] - y0, y1 - x["value"]
        share = lambda d: (d / height >= t.interior_low) & (d / height <= t.interior_high)
        inside = (top > t.interior_margin) & (bottom > t.interior_margin) & (top >= t.min_offset) & (bottom >= t.min_offset)
        return (x["count"] >= t.intrusion_count) & inside & share(top) & share(bottom) & (F.abs(top - bottom) <= t.max_offset_difference)

    below = F.get(F.filter("_lines", lambda x: x["value"] >= y1 - 1e-6), F.lit(0))["value"]
    hit = cells.filter(tx.any_like(F.col("text"), [r"[\p{L}\p{N}]"]) & (height > t.min_height)).join(lines, keys)
    hit = hit.filter(below.isNull() | (below - y1 >= t.gap_below)).withColumn("line", F.round(F.get(F.filter("_lines", fits), F.lit(0))["value"], 2)).filter("line is not null").drop("_lines")
    w = Window.partitionBy(*keys, "line").orderBy("x0", "x1", ident)
    gap = F.col("x0") - F.lag("x1").over(w)
    runs = hit.withColumn("_s", F.when(gap <= t.intrusion_gap, 0).otherwise(1)).withColumn("segment", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "x1", ident, "text"))), lambda s: s["text"]), " ")
    out = runs.groupBy(*keys, "line", "segment").agg(words.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("cells"))
    out = out.filter(F.length(F.replace("text", F.lit(" "), F.lit(""))) >= t.intrusion_chars)
    content = tx.content_type(F.col("text"))
    severity = F.when(tx.suspicion(content) >= 2.5, "HIGH").when(tx.is_common_phrase(F.col("text")), "LOW").otherwise("MEDIUM")
    return out.withColumn("content_type", content).withColumn("severity", severity)


def edge_lists(cells: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """left_edges and right_edges of each page: rounded edges that at least `least` cells share."""
    out = None
    for side, edge in (("left_edges", "x0"), ("right_edges", "x1")):
        n = cells.groupBy(*keys, F.bround(edge).alias("_e")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).groupBy(*keys).agg(F.sort_array(F.collect_list("_e")).alias(side))
        out = n if out is None else out.join(n, keys, "full")
    return out


def page_baselines(cells: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Refined baselines of each page: detected, detected again with the blocks over the first ones, filtered and ordered by confidence."""
    first = baselines.detect(cells, keys)
    return baselines.refine(baselines.detect(cells, keys, blocks.identify(cells, first, keys, ident)), keys)


def anomalies(cells: DataFrame, keys: list[str], ident: str, t: Thresholds = Thresholds(), items: DataFrame | None = None, tables: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """All findings of a page's alignment in one table: kind, text, severity, amount.

    items: structural items (see spatial.best_match); cells that match a header take no part. tables: see blocks.refine;
    with them, columns are judged in refined blocks only.
    """
    kept = spatial.consolidate(cells, keys=tuple(keys), ident=ident)
    if items is not None:
        kept = spatial.suppress_headers(kept, items, keys=tuple(keys), ident=ident).select(*kept.columns)
    kept = cut(kept)  # read by every step below
    found = cut(page_baselines(kept, keys, ident))
    blocked = cut(assign_blocks(kept, keys, ident, t, compat))
    aligned = block_alignment(blocked, keys, ident, t)
    if tables is not None:
        refined = blocks.refine(aligned.withColumnRenamed("confidence", "share"), tables, keys, compat=compat)
        left = refined.select(*keys, F.explode("merged_from").alias("block_id")).select(*keys, F.col("block_id").cast("int").alias("block_id"))
        aligned = aligned.join(left, [*keys, "block_id"], "left_semi")
    columns = column_anomalies(blocked, aligned, keys, ident, t)
    edges = found.filter("side in ('left', 'right')").groupBy(*keys).agg(*[F.collect_list(F.when(F.col("side") == s, F.col("value"))).alias(f"{s}_edges") for s in ("left", "right")])
    vertical = vertical_anomalies(columns, edges, keys).select(*keys, F.lit("vertical").alias("kind"), "text", "severity", F.col("deviation").alias("amount"))
    horizontal = horizontal_anomalies(kept, keys, ident, t, found).select(*keys, F.lit("horizontal").alias("kind"), "text", "severity", F.col("cells").cast("double").alias("amount"))
    return vertical.unionByName(horizontal)
