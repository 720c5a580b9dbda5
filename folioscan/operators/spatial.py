"""Spatial joins of boxes on a page.

Joins go by bins: boxes are dealt into rectangles of `bins` points (width, height) and joined bin by bin; a pair is
judged in one bin only, the one in which its intersection begins, so no distinct is needed and the answer is that of
the join on the page. bins=None joins on the page alone. Neighbourhoods (spacing, clusters) follow the page's own grid,
whose cells are as large as the page's median box.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import geometry as g
from folioscan.operators import blocks, kernels

COORDS = ("x0", "y0", "x1", "y1")
BINS = (72.0, 24.0)


def _sides(boxes: DataFrame, keys: list[str], ident: str) -> tuple[DataFrame, DataFrame]:
    keep = [c for c in (ident, *COORDS, "text") if c in boxes.columns]
    a = boxes.select(*keys, *[F.col(c).alias(f"{c}_a") for c in keep])
    b = boxes.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"{c}_b") for c in keep])
    return a, b


def _same(keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return same


def _dealt(side: DataFrame, box: g.Box, bins: tuple[float, float], name: str) -> DataFrame:
    for axis, size, lo, hi in (("x", bins[0], box[0], box[2]), ("y", bins[1], box[1], box[3])):
        side = side.withColumn(f"_{axis}_{name}", F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))))
    return side


def overlap_join(a: DataFrame, b: DataFrame, box_a: g.Box, box_b: g.Box, keys: list[str], condition: Column | None = None, bins: tuple[float, float] | None = BINS) -> DataFrame:
    """Rows of a and of b (keys named _key there) whose boxes overlap strictly, each pair once."""
    met = _same(keys) & g.meets(box_a, box_b)
    if condition is not None:
        met = met & condition
    if bins is None:
        return a.join(b, met)
    here = (F.col("_x_a") == F.col("_x_b")) & (F.col("_y_a") == F.col("_y_b"))
    begins = (F.floor(F.greatest(box_a[0], box_b[0]) / bins[0]) == F.col("_x_a")) & (F.floor(F.greatest(box_a[1], box_b[1]) / bins[1]) == F.col("_y_a"))
    return _dealt(a, box_a, bins, "a").join(_dealt(b, box_b, bins, "b"), here & met & begins).drop("_x_a", "_y_a", "_x_b", "_y_b")


def overlapping_pairs(boxes: DataFrame, threshold: float = 0.25, mode: str = "iou", keys: tuple[str, ...] = ("page_ix",), ident: str = "box_id", bins: tuple[float, float] | None = BINS) -> DataFrame:
    """(keys, a, b, score) of pairs a < b that overlap strictly with score >= threshold."""
    ks = list(keys)
    a, b = _sides(boxes, ks, ident)
    ba, bb = g.box(suffix="_a"), g.box(suffix="_b")
    joined = overlap_join(a, b, ba, bb, ks, F.col(f"{ident}_a") < F.col(f"{ident}_b"), bins)
    return joined.select(*ks, F.col(f"{ident}_a").alias("a"), F.col(f"{ident}_b").alias("b"), g.overlap_score(ba, bb, mode).alias("score")).filter(F.col("score") >= threshold)


def pair_scores(boxes: DataFrame, keys: tuple[str, ...] = ("page_ix",), ident: str = "box_id", bins: tuple[float, float] | None = BINS) -> DataFrame:
    """Every strictly overlapping pair with its scores in all modes and its metrics."""
    ks = list(keys)
    a, b = _sides(boxes, ks, ident)
    ba, bb = g.box(suffix="_a"), g.box(suffix="_b")
    joined = overlap_join(a, b, ba, bb, ks, F.col(f"{ident}_a") < F.col(f"{ident}_b"), bins)
    scores = [g.overlap_score(ba, bb, m).alias(f"score_{m}") for m in ("min", "iou", "a", "b")]
    return joined.select(*ks, F.col(f"{ident}_a").alias("a"), F.col(f"{ident}_b").alias("b"), *scores, *[c.alias(n) for n, c in g.overlap_metrics(ba, bb).items()])


def consolidate(boxes: DataFrame, tolerance: float = 0.5, keys: tuple[str, ...] = ("page_ix",), ident: str = "box_id", bins: tuple[float, float] = BINS) -> DataFrame:
    """Boxes that don't lie inside a larger one (of equal ones: an earlier one) whose text has theirs, letter case aside.

    A box meets the others in the bin of its upper left corner. A box inside a removed box lies, but for the tolerance,
    inside what removed that one too; consolidate_exact follows the chain itself.
    """
    ks = list(keys)
    outer = boxes.select(*[F.col(k).alias(f"_{k}") for k in ks], F.col(ident).alias("_id"), *[F.col(c).alias(f"{c}_o") for c in COORDS], F.col("text").alias("_text"))
    ba, bo = g.box(), g.box(suffix="_o")
    outer = _dealt(outer, [bo[0] - tolerance, bo[1] - tolerance, bo[2] + tolerance, bo[3] + tolerance], bins, "b")
    here = (F.floor(ba[0] / bins[0]) == F.col("_x_b")) & (F.floor(ba[1] / bins[1]) == F.col("_y_b"))
    larger = (g.area(bo) > g.area(ba)) | ((g.area(bo) == g.area(ba)) & (F.col("_id") < F.col(ident)))
    inside = _same(ks) & here & g.contains(bo, ba, tolerance) & larger & F.lower("_text").contains(F.lower("text"))
    return boxes.join(outer, inside, "left_anti")


def best_match(boxes: DataFrame, items: DataFrame, min_iou: float = 0.6, keys: tuple[str, ...] = ("page_ix",), ident: str = "box_id", item: str = "item_id", bins: tuple[float, float] | None = BINS) -> DataFrame:
    """Each box with the item (sx0, sy0, sx1, sy1) of the largest IoU >= min_iou, the first of equals; null without one."""
    from folioscan.operators import pages

    return pages.best(boxes, items, min_iou, list(keys), ident, item, bins)


def suppress_headers(boxes: DataFrame, items: DataFrame, kinds: tuple[str, ...] = ("column_header", "row_header", "section_header"), keys: tuple[str, ...] = ("page_ix",), **kw) -> DataFrame:
    """Boxes whose best match isn't a header."""
    matched = best_match(boxes, items, keys=keys, **kw)
    headers = items.filter(F.col("kind").isin(*kinds)).select(*keys, "item_id").toDF(*keys, "item_id")
    return matched.join(headers, [*keys, "item_id"], "left_anti")


def suppress_overlaps(boxes: DataFrame, hidden: DataFrame, max_iou: float = 0.05, keys: tuple[str, ...] = ("page_ix",), ident: str = "box_id", bins: tuple[float, float] | None = BINS) -> DataFrame:
    """Boxes that share no more than max_iou with any hidden one (sx0, sy0, sx1, sy1)."""
    ks = list(keys)
    h = hidden.select(*[F.col(k).alias(f"_{k}") for k in ks], "sx0", "sy0", "sx1", "sy1")
    bs = [F.col(c) for c in ("sx0", "sy0", "sx1", "sy1")]
    hit = overlap_join(boxes.select(*ks, ident, *COORDS), h, g.box(), bs, ks, g.iou(g.box(), bs) > max_iou, bins).select(*ks, ident)
    return boxes.join(hit.toDF(*ks, ident), [*ks, ident], "left_anti")


def table_membership(boxes: DataFrame, tables: DataFrame, table_cells: DataFrame, tolerance: float = 2.0, min_iou: float = 0.5, bins: tuple[float, float] | None = BINS) -> DataFrame:
    """Boxes inside a table (page_ix, table_id, tx0..ty1), the first that holds them, with the table cell of best IoU > min_iou."""
    bt = [F.col(c) for c in ("tx0", "ty0", "tx1", "ty1")]
    t = tables.select(F.col("page_ix").alias("_page_ix"), "table_id", "tx0", "ty0", "tx1", "ty1")
    inside = boxes.join(t, _same(["page_ix"]) & g.contains(bt, g.box(), tolerance)).groupBy("page_ix", "box_id", *COORDS).agg(F.min("table_id").alias("table_id"))
    bc = [F.col(c) for c in ("sx0", "sy0", "sx1", "sy1")]
    c = table_cells.select(F.col("page_ix").alias("_page_ix"), F.col("table_id").alias("_table_id"), F.col("item_id").alias("cell_id"), "sx0", "sy0", "sx1", "sy1")
    hits = overlap_join(inside, c, g.box(), bc, ["page_ix", "table_id"], bins=bins).withColumn("_v", g.iou(g.box(), bc)).filter(F.col("_v") > min_iou)
    return hits.groupBy("page_ix", "table_id", "box_id").agg(F.max(F.struct("_v", (-F.col("cell_id")).alias("_m"))).alias("_b")).select("page_ix", "table_id", "box_id", (-F.col("_b._m")).alias("cell_id"), F.col("_b._v").alias("iou"))


def _near(page: np.ndarray, rows: pa.RecordBatch, vertical: bool, align_fraction: float, radius: int) -> Callable[[], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Pairs of neighbours (i, j, gap), some at a time and anew at each call: boxes whose cells in the page's grid lie at most `radius` apart and that
    overlap enough on the other axis; gap is 0 where they overlap on this one too. Boxes without width (or height) have none."""
    boxes = np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in COORDS], axis=1)
    return lambda: blocks.near_some(boxes, vertical, align_fraction, radius, page, np.isfinite(boxes).all(axis=1))


def typical_spacing(boxes: DataFrame, vertical: bool = True, align_fraction: float = 0.15, keys: tuple[str, ...] = ("page_ix",), ident: str = "box_id", radius: int = 1) -> DataFrame:
    """Median, over a page's boxes, of the smallest positive gap to a neighbour, and how many boxes have one."""
    ks, kinds = list(keys), dict(boxes.dtypes)

    def kernel(page: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
        found, spacing, n = blocks.spacings(page, _near(page, rows, vertical, align_fraction, radius)())
        first = pa.array(np.flatnonzero(np.diff(page, prepend=-1))[found])
        return pa.RecordBatch.from_arrays([*(rows.column(k).take(first) for k in ks), pa.array(spacing), pa.array(n)], [*ks, "spacing", "n"])

    return kernels.whole_pages(boxes.select(*ks, *COORDS), ks, kernel, ", ".join(f"{k} {kinds[k]}" for k in ks) + ", spacing double, n long")


def clusters(boxes: DataFrame, cutoff: float | None = None, vertical: bool = True, multiplier: float = 1.25, align_fraction: float = 0.15, keys: tuple[str, ...] = ("page_ix",), ident: str = "box_id", radius: int = 1) -> DataFrame:
    """(keys, ident, component): the smallest ident of those that neighbours at most cutoff apart connect a box with; by default
    the page's typical spacing times the multiplier, any gap where there is none. Pairs are met some at a time and never kept."""
    ks, kinds = list(keys), dict(boxes.dtypes)

    def kernel(page: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
        near = _near(page, rows, vertical, align_fraction, radius)
        most = np.full(page[-1] + 1, np.inf if cutoff is None else cutoff)
        if cutoff is None:
            found, spacing, _ = blocks.spacings(page, near())
            most[found] = multiplier * spacing
        up = np.arange(len(page))
        for i, j, gap in near():
            close = gap <= most[page[i]]
            up = kernels.components_of(len(up), up[i[close]], up[j[close]])[up]
        ids = rows.column(ident)
        place = np.empty(len(up), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(up))
        order = np.lexsort((place, up))
        least = order[np.diff(up[order], prepend=-1) > 0]
        of = np.empty(len(up), np.int64)
        of[up[least]] = least
        return pa.RecordBatch.from_arrays([*(rows.column(k) for k in ks), ids, ids.take(pa.array(of[up]))], [*ks, ident, "component"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*ks, ident]) + f", component {kinds[ident]}"
    return kernels.whole_pages(boxes.select(*ks, ident, *COORDS), ks, kernel, schema)
