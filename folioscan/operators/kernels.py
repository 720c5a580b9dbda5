"""Grouped kernels for what depends on the order of earlier decisions; each works on one page."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of packed pages that a kernel is given at once; a larger page comes alone.
_ROWS = 1 << 16


def packed_pages(rows: DataFrame, keys: list[str], first: str | None = None) -> DataFrame:
    """One row a page: its keys and `rows`, an array of the other columns as structs, in order of the column named first, if any."""
    others = [c for c in rows.columns if c not in keys]
    together = F.collect_list(F.struct(*([first] if first else []), *(c for c in others if c != first)))
    return rows.groupBy(*keys).agg((F.sort_array(together) if first else together).alias("rows"))


def many_pages(packed: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """What the kernel makes of packed pages, given some of them at a time: a page costs no call and no table of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("rows").offsets.to_numpy().astype(np.int64)
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + _ROWS, "right")) - 1)
                yield kernel(batch.slice(at, stop - at))
                at = stop

    return packed.mapInArrow(run, schema)


def whole_pages(rows: DataFrame, keys: list[str], kernel: Callable[[np.ndarray, pa.RecordBatch], pa.RecordBatch], schema: str | StructType, long: str | None = None) -> DataFrame:
    """What the kernel makes of the rows of whole pages, given some pages at a time with the number of each row's page, from 0.

    Rows are dealt by page and sorted, so that no page becomes an array; rows that are so already are not moved again.
    long: a column of arrays, whose items are counted instead of rows, or of counts.
    """

    def numbered(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = batch.column(k)
            apart = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            new[1:] |= apart | (np.diff(c.is_null().to_numpy(zero_copy_only=False)) if c.null_count else False)
        return np.cumsum(new)

    def ends(batch: pa.RecordBatch) -> np.ndarray:
        """How much there is up to each row."""
        if not long:
            return np.arange(1, batch.num_rows + 1)
        c = batch.column(long)
        return (c.to_numpy() if pa.types.is_integer(c.type) else np.diff(c.offsets.to_numpy().astype(np.int64))).cumsum()

    def made(batch: pa.RecordBatch, page: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        last = np.append(np.flatnonzero(np.diff(page)), len(page) - 1)  # of each page
        at = done = 0
        while at < len(last):
            stop = max(at + 1, int(np.searchsorted(size[last], done + _ROWS, "right")))
            a, b = last[at - 1] + 1 if at else 0, last[stop - 1] + 1
            yield kernel(page[a:b] - page[a], batch.slice(a, b - a))
            at, done = stop, size[b - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, _ROWS
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += int(ends(batch)[-1])
            if n < enough:
                continue
            together = pa.concat_batches(held)
            page, size = numbered(together), ends(together)
            last = int(np.searchsorted(page, page[-1]))
            if last:
                yield from made(together.slice(0, last), page[:last], size[:last])
            held, n = [together.slice(last)], n - (int(size[last - 1]) if last else 0)
            enough = max(_ROWS, 2 * n)
        if held:
            together = pa.concat_batches(held)
            yield from made(together, numbered(together), ends(together))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def rows_of(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(place of the page of each row, the rows' columns) of packed pages."""
    flat = lists.flatten()
    page = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return page, dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))


def per_page(df: DataFrame, keys: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(kernel, schema)


def find_components(n: int, edges: list[tuple[int, int]]) -> np.ndarray:
    """The smallest member of each node's component (union by smaller root, path halving)."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)], np.int64)


def components_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """find_components of all edges at once: in each round every root that has a smaller one beside it goes below it."""
    up = np.arange(n)
    while True:
        a, b = up[i], up[j]
        apart = a != b
        if not apart.any():
            return up
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, up[up]):
            up = up[up]


def components(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("page_ix",), ident: str = "box_id") -> DataFrame:
    """(keys, ident, component): the smallest ident of each component of a page."""
    ks = list(keys)

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(ident)
        ids = left[ident].to_numpy()
        e = zip(np.searchsorted(ids, right["a"]), np.searchsorted(ids, right["b"]), strict=True)
        return left.assign(component=ids[find_components(len(ids), list(e))] if len(ids) else [])[[*ks, ident, "component"]]

    edges = edges.select(*ks, "a", "b").toDF(*ks, "a", "b")  # new columns: both sides may come from one table
    kinds = dict(nodes.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*ks, ident]) + ", component long"
    return nodes.select(*ks, ident).groupBy(*ks).cogroup(edges.groupBy(*ks)).applyInPandas(kernel, schema)


def fold_lines(centers: np.ndarray, tolerance: float = 1.5, group: np.ndarray | None = None) -> np.ndarray:
    """Line number of each cell, given ascending centres: the first line whose running mean is within tolerance.

    A line that a centre has left behind is met by none of those after it. group: ascending; each begins anew.
    """
    sums: list[float] = []
    counts: list[int] = []
    out = np.empty(len(centers), np.int64)
    first = 0
    begins = set() if group is None else set((np.flatnonzero(np.diff(group)) + 1).tolist())
    for i, c in enumerate(np.asarray(centers, float).tolist()):
        if i in begins:
            sums, counts, first = [], [], 0
        while first < len(sums) and c - sums[first] / counts[first] > tolerance:
            first += 1
        for k in range(first, len(sums)):
            if abs(c - sums[k] / counts[k]) <= tolerance:
                break
        else:
            k = len(sums)
            sums.append(0.0)
            counts.append(0)
        sums[k] += c
        counts[k] += 1
        out[i] = k
    return out


def merge_spans(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def span_overlap_ratio(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """Shared length over the shorter of two unions of intervals."""
    a, b = merge_spans(a), merge_spans(b)
    shared = sum(max(0.0, min(p[1], q[1]) - max(p[0], q[0])) for p in a for q in b)
    shorter = min(sum(y - x for x, y in a), sum(y - x for x, y in b))
    return shared / shorter if shorter > 0 else 0.0


def chain_merge(values: list[dict], tolerance: float = 3.0, min_overlap: float = 0.30) -> list[dict]:
    """Vertical baselines {side, value, count, spans}: in order of value, each is folded into the last kept one if that has
    its side, is within tolerance and overlaps enough; the value is the mean weighted by counts, sums are added."""
    kept: list[dict] = []
    for v in sorted(values, key=lambda v: v["value"]):
        last = kept[-1] if kept else None
        if last and last["side"] == v["side"] and v["value"] - last["value"] <= tolerance and span_overlap_ratio(last["spans"], v["spans"]) >= min_overlap:
            n = last["count"] + v["count"]
            added = {k: last[k] + v[k] for k in ("block_support", "s0", "s1", "s2") if k in last}
            kept[-1] = last | added | {"value": (last["value"] * last["count"] + v["value"] * v["count"]) / n, "count": n, "spans": last["spans"] + v["spans"], "merged": True}
        else:
            kept.append(v)
    return kept


def suppress_near(values: np.ndarray, counts: np.ndarray, distance: float = 5.0) -> np.ndarray:
    """Greedy suppression: in order of falling count (ties: smaller value), keep what lies at least distance from all kept."""
    keep = np.zeros(len(values), bool)
    taken: list[float] = []
    known = bool(np.isfinite(values).all())  # in order, the nearest taken one on either side decides
    for i in np.lexsort((values, -counts)).tolist():
        v = float(values[i])
        at = bisect_left(taken, v) if known else len(taken)
        if all(abs(v - t) >= distance for t in (taken[max(0, at - 1) : at + 1] if known else taken)):
            keep[i] = True
            taken.insert(at, v)
    return keep


def consolidate_exact(areas: np.ndarray, boxes: np.ndarray, texts: list[str], tolerance: float = 0.5) -> np.ndarray:
    """Kept boxes: by falling area, one goes if it lies inside a kept one whose text has its text."""
    keep = np.zeros(len(areas), bool)
    for i in np.argsort(-areas, kind="stable"):
        x0, y0, x1, y1 = boxes[i]
        for k in np.flatnonzero(keep):
            b = boxes[k]
            if x0 >= b[0] - tolerance and y0 >= b[1] - tolerance and x1 <= b[2] + tolerance and y1 <= b[3] + tolerance and texts[i].lower() in texts[k].lower():
                break
        else:
            keep[i] = True
    return keep


def box_overlap(a, b) -> tuple[float, float, float]:
    """IoU and the shares of either box, to 3 places."""
    w, h = (min(a[k + 2], b[k + 2]) - max(a[k], b[k]) for k in (0, 1))
    shared = max(0.0, w) * max(0.0, h)
    areas = [max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1]) for x in (a, b)]
    ratios = [shared / below if below > 0 else 0.0 for below in (sum(areas) - shared, *areas)]
    return tuple(round(r, 3) for r in ratios)


def table_of(box, tables: list, min_iou: float = 0.5) -> int | None:
    """The place of the first table that the box covers."""
    return next((k for k, t in enumerate(tables) if box_overlap(box, t)[0] >= min_iou), None)


def merge_adjacent(blocks: list[dict], max_gap: float = 15.0, center_tolerance: float = 20.0, tables: list = ()) -> list[dict]:
    """Blocks {bbox, alignment, cells, merged_from}: passes over neighbours in order of y0 until none merges.

    Two neighbours merge if both are left- or both right-aligned, the gap between them is 0 to max_gap, they cover one
    table or none, and their centres differ by center_tolerance at most. A merged block keeps what else the first one
    has, but for its confidence.
    """
    blocks = sorted(blocks, key=lambda b: b["bbox"][1])
    while True:
        out, i, merged = [], 0, False
        while i < len(blocks):
            a, b = blocks[i], blocks[i + 1] if i + 1 < len(blocks) else None
            if b and _mergeable(a, b, max_gap, center_tolerance, tables):
                box = tuple(f(p, q) for f, p, q in zip((min, min, max, max), a["bbox"], b["bbox"], strict=True))
                out.append(a | {"bbox": box, "cells": a["cells"] + b["cells"], "merged_from": a["merged_from"] + b["merged_from"], "confidence": None})
                merged, i = True, i + 2
            else:
                out.append(a)
                i += 1
        blocks = out
        if not merged:
            return blocks


def _mergeable(a: dict, b: dict, max_gap: float, center_tolerance: float, tables: list) -> bool:
    gap = b["bbox"][1] - a["bbox"][3]
    centers = [(x["bbox"][0] + x["bbox"][2]) / 2 for x in (a, b)]
    alike = a["alignment"] == b["alignment"] and a["alignment"] in ("left", "right") and 0 <= gap <= max_gap and abs(centers[0] - centers[1]) <= center_tolerance
    return alike and table_of(a["bbox"], tables) == table_of(b["bbox"], tables)


def block_confidence(box, cells: int, alignment: float, tables: list = ()) -> float:
    """Cells, alignment, density, cells by height and a table's support in one number, to 3 places."""
    w, h = box[2] - box[0], box[3] - box[1]
    dense = min(cells / (w * h) / 5e-4, 1.0) if w * h > 0 else 0.0
    tall = min(cells / h / 0.1, 1.0) if h > 0 else 0.0
    return round(0.25 * min(cells / 20, 1.0) + 0.25 * alignment + 0.15 * dense + 0.15 * tall + (0.2 if table_of(box, tables, 0.7) is not None else 0.0), 3)


def drop_nested(boxes: np.ndarray, confidence: np.ndarray, overlap_ratio: float = 0.8, area_ratio: float = 0.5, difference: float = 0.2) -> np.ndarray:
    """Kept blocks: the smaller of a pair goes if it mostly lies in the other, is much smaller and less certain.

    Pairs are taken in order; a block that has gone is compared no more, but its own round goes on to the end.
    """
    keep = np.ones(len(boxes), bool)
    areas = [(b[2] - b[0]) * (b[3] - b[1]) for b in boxes]
    for i in range(len(boxes)):
        if not keep[i]:
            continue
        for j in range(len(boxes)):
            if i == j or not keep[j] or max(box_overlap(boxes[i], boxes[j])[1:]) < overlap_ratio:
                continue
            small, large = (i, j) if areas[i] < areas[j] else (j, i)
            if (areas[small] / areas[large] if areas[large] > 0 else 0.0) < area_ratio and confidence[large] - confidence[small] >= difference:
                keep[small] = False
    return keep


def drop_weak(boxes: list, cells: list[int], min_strength: float = 0.05, max_iou: float = 0.3) -> np.ndarray:
    """Kept blocks: one of few cells for its height goes if it overlaps one of more."""
    strength = np.array([n / (b[3] - b[1]) if b[3] > b[1] else 0.0 for b, n in zip(boxes, cells, strict=True)])
    strong = [b for b, s in zip(boxes, strength, strict=True) if s >= min_strength]
    return np.array([s >= min_strength or all(box_overlap(b, x)[0] <= max_iou for x in strong) for b, s in zip(boxes, strength, strict=True)], bool)


def greedy_match(candidates: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """One-to-one: in order of the left index, the free right one of the strictly highest score; of equals the first."""
    best: dict[int, list[tuple[int, float]]] = {}
    for a, b, s in sorted(candidates):
        best.setdefault(a, []).append((b, s))
    taken: set[int] = set()
    out = []
    for a in sorted(best):
        free = [(b, s) for b, s in best[a] if b not in taken]
        if free:
            b, s = max(free, key=lambda x: (x[1], -x[0]))
            taken.add(b)
            out.append((a, b, s))
    return out


def islands_apart(values: np.ndarray, members: list[int], eps: float, columns: list) -> list[list[int]]:
    """Islands of members by value where cells of different columns of one table are never neighbours.

    columns: (table, column) of each cell, None for cells outside tables; two cells join if they lie within eps and not
    in different columns of one table, or over others that do.
    """
    order = sorted(members, key=lambda i: (values[i], i))
    edges, first = [], 0
    for k, i in enumerate(order):
        while values[i] - values[order[first]] > eps:
            first += 1
        for m in range(first, k):
            a, b = columns[i], columns[order[m]]
            if a is None or b is None or a[0] != b[0] or a[1] == b[1]:
                edges.append((m, k))
    label = find_components(len(order), edges)
    return [[order[k] for k in np.flatnonzero(label == x)] for x in np.unique(label)]


def split_iteratively(cx: np.ndarray, cy: np.ndarray, v_eps: float = 12.0, h_eps: float = 40.0, max_passes: int = 3, compat: bool = False, columns: list | None = None) -> list[list[int]]:
    """Blocks of cells by islands of their centres, along y, then x, then y again.

    Islands of one cell are noise. Two or more noise cells of a block make a block of their own, ahead of its islands; a
    single one stays with the block's only island and is lost among several. A pass that splits nothing is the last.
    columns: the (table, column) of cells in tables; passes along x keep the columns of a table apart, passes along y
    don't. compat: a block of noise alone is given twice, and columns are passed over.
    """
    blocks = [list(range(len(cx)))] if len(cx) else []
    for p in range(max_passes):
        axis, eps = (cy, v_eps) if p % 2 == 0 else (cx, h_eps)
        out, split = [], False
        for block in blocks:
            order = sorted(block, key=lambda i: (axis[i], i))
            islands: list[list[int]] = []
            if columns is not None and p % 2 and not compat:
                islands, order = islands_apart(axis, block, eps, columns), []
            for i in order:
                if islands and axis[i] - axis[islands[-1][-1]] <= eps:
                    islands[-1].append(i)
                else:
                    islands.append([i])
            noise, real = [x[0] for x in islands if len(x) == 1], [x for x in islands if len(x) > 1]
            if len(noise) >= 2:
                out.append(noise)
            if len(real) >= 2:
                out += real
                split = True
            elif len(real) == 1:
                out.append(real[0] + (noise if len(noise) == 1 else []))
            elif len(noise) < 2 or compat:
                out.append(noise)
        blocks = out
        if not split:
            break
    return [b for b in blocks if len(b) >= 2]


def walk_clip(operations: list[tuple[str, str | None]], forms: dict[str, list] | None = None, clipped: bool = False, _inside: tuple[str, ...] = ()) -> list[tuple[str | None, bool]]:
    """(text, clipped) for each show operator: q saves and Q restores the clip flag (a stray Q clears it), W and W* set it.

    Do walks the form it names, which begins with the flag as it stands and leaves it as it was; a form inside itself is
    passed over.
    """
    stack, out = [], []
    for op, text in operations:
        if op == "q":
            stack.append(clipped)
        elif op == "Q":
            clipped = stack.pop() if stack else False
        elif op in ("W", "W*"):
            clipped = True
        elif op in ("Tj", "TJ", "'", '"'):
            out.append((text, clipped))
        elif op == "Do" and text in (forms or {}) and text not in _inside:
            out += walk_clip(forms[text], forms, clipped, (*_inside, text))
    return out
