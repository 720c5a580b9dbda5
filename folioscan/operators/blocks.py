"""Text blocks of a page: found from cells and baselines, scored, merged, freed of nested and weak ones."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import geometry as g
from folioscan.operators import kernels


@dataclass(frozen=True)
class Limits:
    """Fixed values of block detection and refinement, in points unless they are counts or shares."""

    align_fraction: float = 0.15
    radius: int = 1
    spacing_multiplier: float = 1.35
    column_multiplier: float = 1.15
    min_cutoff: float = 8.0
    fallback_gap: float = 36.0
    baseline_count: int = 3
    snap: float = 5.0
    cell_snap: float = 3.0
    min_lines: int = 2
    max_width_deviation: float = 18.0
    min_dominance: float = 0.55
    block_dominance: float = 0.6
    max_gap: float = 15.0
    center_tolerance: float = 20.0
    overlap_ratio: float = 0.8
    area_ratio: float = 0.5
    confidence_difference: float = 0.2
    min_strength: float = 0.05
    weak_iou: float = 0.3


def nearest(values: Column, edge: Column) -> Column:
    """(distance, value) of the array's value nearest to the edge, the smaller of equals; null for none."""
    return F.array_min(F.transform(values, lambda v: F.struct(F.abs(edge - v).alias("d"), v.alias("v"))))


def classify_cells(cells: DataFrame, baselines: DataFrame, keys: list[str], t: Limits = Limits()) -> DataFrame:
    """cells with orientation, baseline_value, baseline_diff and anchor_x: by the nearest left baseline, else the nearest right one, else as centred."""
    used = baselines.filter(F.col("side").isin("left", "right") & (F.col("count") >= t.baseline_count))
    sides = used.groupBy(*keys).agg(*[F.collect_list(F.when(F.col("side") == s, F.col("value"))).alias(f"_{s}") for s in ("left", "right")])
    j = cells.join(sides, keys, "left").withColumn("_l", nearest(F.col("_left"), F.col("x0"))).withColumn("_r", nearest(F.col("_right"), F.col("x1")))
    left, right, centre = F.col("_l.d") <= t.cell_snap, F.col("_r.d") <= t.cell_snap, (F.col("x0") + F.col("x1")) / 2
    pick = lambda a, b, c: F.when(left, a).when(right, b).otherwise(c)
    return j.select(
        *cells.columns, pick("left", "right", "center").alias("orientation"), pick(F.col("_l.v"), F.col("_r.v"), centre).alias("baseline_value"),
        pick(F.col("_l.d"), F.col("_r.d"), F.lit(None)).alias("baseline_diff"), pick(F.col("x0"), F.col("x1"), centre).alias("anchor_x"),
    )


# --- detection ------------------------------------------------------------------------------------------------------------


#: Comparisons made at once.
_AT_ONCE = 1 << 18


def _medians(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Median of the values of each group; group: 0, 1, ... in any order, none empty."""
    v, n = values[np.lexsort((values, group))], np.bincount(group, minlength=groups)
    first = np.cumsum(n) - n
    return (v[first + (n - 1) // 2] + v[first + n // 2]) / 2


def near_pairs(boxes: np.ndarray, vertical: bool, align_fraction: float, radius: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of near_some in a row."""
    return tuple(np.concatenate(x) for x in zip(*near_some(boxes, vertical, align_fraction, radius, group), strict=True))


def near_some(boxes: np.ndarray, vertical: bool, align_fraction: float, radius: int, group: np.ndarray | None = None, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, gap), some at a time, of boxes i < j in neighbouring cells of the page's grid that overlap enough on the other axis.

    Boxes go in order of their first row; a box is compared with those behind it whose first row is near its last one,
    some boxes at a time. group: ascending from 0, all of them present; each has a grid and pairs of its own.
    known: only these boxes have pairs; a side that isn't known counts as none in the size of the grid.
    """
    n = len(boxes)
    group = np.zeros(n, np.int64) if group is None else group
    first = np.flatnonzero(np.diff(group, prepend=-1))
    larger, least = (np.maximum, np.minimum) if known is None else (np.fmax, np.fmin)
    sides = larger(boxes[:, 2:] - boxes[:, :2], 1e-12)
    size = np.stack([_medians(sides[:, k], group, len(first)) for k in (0, 1)], axis=1)[group]
    corner = least.reduceat(boxes[:, :2], first)[group]
    low, high = (np.floor((x - corner) / size) for x in (boxes[:, :2], boxes[:, 2:]))
    if known is not None:
        low, high = (np.where(known[:, None], x, 0.0) for x in (low, high))
    low, high = low.astype(np.int64), high.astype(np.int64)
    _, ranks = np.unique(np.concatenate([low[:, 1], high[:, 1] + radius]), return_inverse=True)
    start, last = group * (2 * n) + ranks[:n], group * (2 * n) + ranks[n:]
    order = np.argsort(start, kind="stable")
    ends = np.searchsorted(start[order], last[order], "right")
    main, other = (1, 0) if vertical else (0, 1)
    at = 0
    while at < n:
        counts = np.maximum(0, ends[at:] - np.arange(at + 1, n + 1))
        stop = at + max(1, int(np.searchsorted(np.cumsum(counts), _AT_ONCE, "right")))
        counts = counts[: stop - at]
        total = int(counts.sum())
        a = np.repeat(np.arange(at, stop), counts)
        b = a + 1 + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        a, b = order[a], order[b]
        i, j = np.minimum(a, b), np.maximum(a, b)
        ok = (low[j, 0] <= high[i, 0] + radius) & (high[j, 0] >= low[i, 0] - radius)
        i, j = i[ok], j[ok]
        shared = np.maximum(0, np.minimum(boxes[i, other + 2], boxes[j, other + 2]) - np.maximum(boxes[i, other], boxes[j, other]))
        narrow = np.minimum(boxes[i, other + 2] - boxes[i, other], boxes[j, other + 2] - boxes[j, other])
        ok = (narrow > 0) & (shared >= align_fraction * narrow)
        if known is not None:
            ok &= known[i] & known[j] & (low[j, 1] <= high[i, 1] + radius) & (high[j, 1] >= low[i, 1] - radius)
        i, j = i[ok], j[ok]
        yield i, j, np.maximum(0, np.maximum(boxes[j, main] - boxes[i, main + 2], boxes[i, main] - boxes[j, main + 2]))
        at = stop


def spacing_of(n: int, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Median of the smallest positive gaps, 0 without any."""
    return float(_spacings(np.zeros(n, np.int64), pairs, 1)[0])


def _spacings(group: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], groups: int) -> np.ndarray:
    """The same for each group."""
    found, median, _ = spacings(group, [pairs])
    out = np.zeros(groups)
    out[found] = median
    return out


def spacings(group: np.ndarray, pairs: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, median of its boxes' smallest positive gaps, how many boxes have one) of the groups that have any."""
    least = np.full(len(group), np.inf)
    for i, j, d in pairs:
        i, j, d = (x[d > 0] for x in (i, j, d))
        np.minimum.at(least, i, d)
        np.minimum.at(least, j, d)
    some = np.isfinite(least)
    found, code, n = np.unique(group[some], return_inverse=True, return_counts=True)
    return found, _medians(least[some], code, len(found)), n


def _clusters(n: int, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], cutoff: float) -> list[list[int]]:
    i, j, d = pairs
    label = kernels.find_components(n, list(zip(i[d <= cutoff].tolist(), j[d <= cutoff].tolist(), strict=True)))
    return [np.flatnonzero(label == k).tolist() for k in np.unique(label)]


def _lines(centers: np.ndarray, cluster: list[int]) -> list[list[int]]:
    """Members of the cluster line by line, from the top."""
    order = sorted(cluster, key=lambda i: centers[i])
    number = kernels.fold_lines(centers[order])
    lines = [[i for i, k in zip(order, number, strict=True) if k == line] for line in range(int(number.max()) + 1)]
    return sorted(lines, key=lambda x: centers[x].mean())


def _cohesion(boxes: np.ndarray, kinds: list[str], cluster: list[int], n_lines: int, t: Limits) -> str | None:
    """Why a cluster is no block, if it isn't."""
    if n_lines < t.min_lines:
        return "below_min_lines"
    small = len(cluster) <= 2
    dominance = Counter(kinds[i] for i in cluster).most_common(1)[0][1] / len(cluster)
    turned = dominance < t.min_dominance and not small
    wide = np.std(boxes[cluster, 2] - boxes[cluster, 0]) > t.max_width_deviation and not small
    return {(True, True): "orientation_and_width_variance", (True, False): "orientation_variance", (False, True): "width_variance"}.get((turned, bool(wide)))


def _dominant(kinds: list[str], share: float) -> str:
    kind, n = Counter(kinds).most_common(1)[0]
    return kind if n / len(kinds) >= share else "mixed"


def find_blocks(boxes: np.ndarray, kinds: list[str], values: list[float], left: list[float], right: list[float], t: Limits = Limits()) -> tuple[list[dict], list[str]]:
    """(blocks, reasons of the clusters turned down) of one page's boxes with their orientations and baselines."""
    if len(boxes) < t.min_lines:
        return [], []
    centers = (boxes[:, 1] + boxes[:, 3]) / 2
    pairs = near_pairs(boxes, True, t.align_fraction, t.radius)
    typical = spacing_of(len(boxes), pairs)
    cutoff = max(t.spacing_multiplier * typical, t.min_cutoff) if typical > 0 else t.fallback_gap
    accepted, reasons = [], []
    for cluster in _clusters(len(boxes), pairs, cutoff):
        if len(cluster) == 1 < t.min_lines:
            reasons.append("below_min_lines")
            continue
        part = np.array(cluster)
        inner = near_pairs(boxes[part], False, t.align_fraction, t.radius)
        apart = spacing_of(len(part), inner)
        for column in _clusters(len(part), inner, t.column_multiplier * apart if apart > 0 else np.inf):
            column = part[column].tolist()
            lines = _lines(centers, column)
            why = _cohesion(boxes, kinds, column, len(lines), t)
            reasons += [why] if why else []
            accepted += [] if why else [(column, lines)]
    out = []
    for column, lines in sorted(accepted, key=lambda x: boxes[x[0], 1].min()):
        middle = [centers[x].mean() for x in lines]
        gaps = [max(0.0, b - a) for a, b in zip(middle, middle[1:], strict=False)]
        ordered = [i for line in lines for i in line]
        kind = _dominant([kinds[i] for i in ordered], t.block_dominance)
        anchors = [values[i] for i in ordered if kinds[i] in ("left", "right")]
        box = [*boxes[column, :2].min(axis=0), *boxes[column, 2:].max(axis=0)]
        for side, at, baselines in (("left", 0, left), ("right", 2, right)):
            near = [(abs(box[at] - b), k) for k, b in enumerate(baselines) if abs(box[at] - b) <= t.snap]
            if kind == side and near:
                box[at] = baselines[min(near)[1]]
        mode = Counter(round(d * 2) / 2 for d in gaps).most_common(1)[0][0]
        out.append({
            "block_id": len(out) + 1, **dict(zip(("x0", "y0", "x1", "y1"), map(float, box), strict=True)), "cell_count": len(column), "line_count": len(lines), "line_spacing_mean": round(sum(gaps) / len(gaps), 3),
            "line_spacing_mode": float(mode), "dominant_alignment": kind, "alignment_baseline": float(np.median(anchors)) if anchors else None, "line_centers": [round(float(c), 3) for c in middle],
        })
    return out, reasons


KINDS = ("left", "right", "center")


def find_in_pages(page: np.ndarray, boxes: np.ndarray, kinds: np.ndarray, values: np.ndarray, left: list, right: list, t: Limits = Limits()) -> dict[str, list]:
    """find_blocks of many pages at once: the columns of their blocks, `page` first; page ascends from 0 and none is empty.

    kinds: places in KINDS; left, right: the baselines of each page. The steps are those of find_blocks over (page,
    cluster, column) as one key; lines alone are folded box by box.
    """
    n = len(boxes)
    centers = (boxes[:, 1] + boxes[:, 3]) / 2
    i, j, d = pairs = near_pairs(boxes, True, t.align_fraction, t.radius, page)
    typical = _spacings(page, pairs, len(left))
    cutoff = np.where(typical > 0, np.maximum(t.spacing_multiplier * typical, t.min_cutoff), t.fallback_gap)
    near = d <= cutoff[page[i]]
    root = kernels.components_of(n, i[near], j[near])
    rows = np.argsort(root, kind="stable")
    rows = rows[np.bincount(root, minlength=n)[root[rows]] > (1 if t.min_lines > 1 else 0)]
    names = ["page", *(c.split()[0] for c in _BLOCK.split(", "))]
    if not len(rows):
        return {c: [] for c in names}
    page, boxes, centers, kinds, values = page[rows], boxes[rows], centers[rows], kinds[rows], values[rows]
    _, cluster = np.unique(root[rows], return_inverse=True)
    i, j, d = pairs = near_pairs(boxes, False, t.align_fraction, t.radius, cluster)
    apart = _spacings(cluster, pairs, int(cluster[-1]) + 1)
    near = d <= np.where(apart > 0, t.column_multiplier * apart, np.inf)[cluster[i]]
    root = kernels.components_of(len(rows), i[near], j[near])

    # boxes by column and centre: a column is a stretch, its lines are numbered in it and put in order of their means
    order = np.lexsort((centers, root))
    root, page, boxes, centers, kinds, values = root[order], page[order], boxes[order], centers[order], kinds[order], values[order]
    first = np.flatnonzero(np.diff(root, prepend=-1))
    size = np.diff(np.append(first, len(root)))
    column = np.repeat(np.arange(len(first)), size)
    line = kernels.fold_lines(centers, group=column)
    found, member = np.unique(column * (len(root) + 1) + line, return_inverse=True)
    middle, of = np.bincount(member, centers) / np.bincount(member), found // (len(root) + 1)
    by_mean = np.lexsort((found, middle, of))
    place = np.empty(len(found), np.int64)
    place[by_mean] = np.arange(len(found))
    middle, of = middle[by_mean], of[by_mean]
    n_lines = np.bincount(of, minlength=len(first))
    counts = np.bincount(column * 3 + kinds, minlength=3 * len(first)).reshape(-1, 3)
    width = boxes[:, 2] - boxes[:, 0]
    mean = np.bincount(column, width) / size
    spread = np.sqrt(np.bincount(column, (width - mean[column]) ** 2) / size)
    large = size > 2
    good = (n_lines >= t.min_lines) & ~(large & (counts.max(axis=1) / size < t.min_dominance)) & ~(large & (spread > t.max_width_deviation))

    # the most frequent kind; of equals the one that comes first in order of lines
    met = np.full((len(first), 3), len(root), np.int64)
    at = np.empty(len(root), np.int64)
    at[np.lexsort((np.arange(len(root)), place[member]))] = np.arange(len(root))
    np.minimum.at(met, (column, kinds), at)
    best = (counts * (len(root) + 1) - met).argmax(axis=1)
    mixed = counts[np.arange(len(first)), best] / size < t.block_dominance
    low, high = np.minimum.reduceat(boxes[:, :2], first), np.maximum.reduceat(boxes[:, 2:], first)
    box = np.concatenate([low, high], axis=1)
    inner = of[1:] == of[:-1]
    gap, of_gap = np.maximum(0.0, np.diff(middle))[inner], of[1:][inner]
    n_gaps = np.bincount(of_gap, minlength=len(first))
    mean_gap = np.bincount(of_gap, gap, minlength=len(first)) / np.maximum(1, n_gaps)
    mode = _modes(np.rint(gap * 2) / 2, of_gap, len(first))
    anchored = kinds < 2
    has, code = np.unique(column[anchored], return_inverse=True)
    anchor = np.full(len(first), np.nan)
    anchor[has] = _medians(values[anchored], code, len(has))

    order = np.lexsort((np.arange(len(first)), low[:, 1], page[first]))
    order = order[good[order]]
    pages, line_ends = page[first][order], np.cumsum(n_lines)
    number = np.arange(len(order)) - np.searchsorted(pages, pages) + 1
    for k, p in zip(order.tolist(), pages.tolist(), strict=True):
        side = best[k]
        if not mixed[k] and side < 2:
            baselines = (left, right)[side][p]
            away = np.abs(baselines - box[k, 2 * side])
            if len(away) and away.min() <= t.snap:
                box[k, 2 * side] = baselines[away.argmin()]
    rounded = [round(c, 3) for c in middle.tolist()]
    return dict(zip(names, (
        pages, number, *box[order].T, size[order], n_lines[order], [round(x, 3) for x in mean_gap[order].tolist()], mode[order], [("mixed" if m else KINDS[k]) for k, m in zip(best[order], mixed[order], strict=True)],
        [None if x != x else x for x in anchor[order].tolist()], [rounded[e - m : e] for e, m in zip(line_ends[order].tolist(), n_lines[order].tolist(), strict=True)],
    ), strict=True))


def _modes(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The most frequent value of each group, of equals the one met first; 0 for an empty group."""
    out = np.zeros(groups)
    if len(values):
        order = np.lexsort((values, group))
        new = np.flatnonzero(np.append(True, (np.diff(values[order]) != 0) | (np.diff(group[order]) != 0)))
        times = np.diff(np.append(new, len(values)))
        firsts, of = np.minimum.reduceat(order, new), group[order][new]
        ranked = np.lexsort((firsts, -times, of))
        head = ranked[np.flatnonzero(np.diff(of[ranked], prepend=-1))]
        out[of[head]] = values[order][new][head]
    return out


_BLOCK = "block_id long, x0 double, y0 double, x1 double, y1 double, cell_count long, line_count long, line_spacing_mean double, line_spacing_mode double, dominant_alignment string, alignment_baseline double, line_centers array<double>"


def identify(cells: DataFrame, baselines: DataFrame, keys: list[str], ident: str = "box_id", t: Limits = Limits()) -> DataFrame:
    """Blocks of each page: vertical runs of cells, split into columns, those that hold together."""
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + _BLOCK
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        page, rows = kernels.rows_of(batch.column("rows"))
        sides = [[np.array(x or [], float) for x in batch.column(c).to_pylist()] for c in ("_left", "_right")]
        boxes = np.stack([rows[c].to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "y0", "x1", "y1")], axis=1)
        orientation, value = pc.index_in(rows["orientation"], pa.array(KINDS)).to_numpy(), rows["baseline_value"].to_numpy(zero_copy_only=False).astype(float)
        unknown = np.zeros(batch.num_rows, bool)
        unknown[page[~np.isfinite(boxes).all(axis=1)]] = True
        out = {c: [] for c in ("page", *names)}
        known, at = ~unknown[page], np.flatnonzero(~unknown)
        if len(at):
            found = find_in_pages(np.searchsorted(at, page[known]), boxes[known], orientation[known], value[known], *[[x[k] for k in at] for x in sides], t)
            out = {c: list(x) for c, x in found.items()}
            out["page"] = at[np.asarray(out["page"], np.int64)].tolist()
        for k in np.flatnonzero(unknown):  # boxes with unknown sides have no grid to share
            of = page == k
            for b in find_blocks(boxes[of], [KINDS[x] for x in orientation[of]], value[of].tolist(), *[x[k].tolist() for x in sides], t)[0]:
                for c, x in (b | {"page": k}).items():
                    out[c].append(x)
        of = pa.array(np.asarray(out["page"], np.int64))
        arrow = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
        columns = [pa.array(out[c.split()[0]], arrow[c.split()[1]]) for c in _BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), *columns], [*keys, *names])

    used = baselines.filter(F.col("count") >= t.baseline_count)
    order = F.sort_array(F.collect_list(F.struct("rank", "value")))
    sides = None
    for s in ("left", "right"):
        one = used.filter(F.col("side") == s).groupBy(*keys).agg(F.transform(order, lambda x: x["value"]).alias(f"_{s}"))
        sides = one if sides is None else sides.join(one, keys, "full")
    placed = classify_cells(cells, baselines, keys, t).select(*keys, ident, "x0", "y0", "x1", "y1", "orientation", "baseline_value")
    return kernels.many_pages(kernels.packed_pages(placed, keys, ident).join(sides, keys, "left"), kernel, schema)


def fold(cells: DataFrame, keys: list[str], ident: str = "box_id", tolerance: float = 1.5) -> DataFrame:
    """(keys, ident, line): lines of a page from the top, by the running mean of their cells' centres; equal centres in order of ident."""
    kinds = dict(cells.dtypes)

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        p = p.assign(c=(p.y0 + p.y1) / 2).sort_values(["c", ident], kind="stable")
        p["line"] = kernels.fold_lines(p.c.to_numpy(), tolerance)
        return p[[*keys, ident, "line"]]

    return cells.select(*keys, ident, "y0", "y1").groupBy(*keys).applyInPandas(kernel, ", ".join(f"{k} {kinds[k]}" for k in (*keys, ident)) + ", line long")


def iterative(cells: DataFrame, keys: list[str], ident: str = "box_id", v_eps: float = 12.0, h_eps: float = 40.0, passes: int = 3) -> DataFrame:
    """(keys, block_id, cell_count, box) of the blocks of kernels.split_iteratively."""
    kinds = dict(cells.dtypes)

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(ident)
        box = p[["x0", "y0", "x1", "y1"]].to_numpy(float)
        found = kernels.split_iteratively((box[:, 0] + box[:, 2]) / 2, (box[:, 1] + box[:, 3]) / 2, v_eps, h_eps, passes)
        page = tuple(p[k].iloc[0] for k in keys)
        rows = [(*page, k, len(b), *box[b, :2].min(axis=0).tolist(), *box[b, 2:].max(axis=0).tolist()) for k, b in enumerate(found)]
        return pd.DataFrame(rows, columns=[*keys, "block_id", "cell_count", "x0", "y0", "x1", "y1"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block_id long, cell_count long, x0 double, y0 double, x1 double, y1 double"
    return cells.select(*keys, ident, "x0", "y0", "x1", "y1").groupBy(*keys).applyInPandas(kernel, schema)


# --- refinement -----------------------------------------------------------------------------------------------------------


def _of_page(tables: DataFrame, keys: list[str]) -> DataFrame:
    """The tables (table_id, tx0, ty0, tx1, ty1) of a page as one array in order; a page has few."""
    return tables.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("table_id", "tx0", "ty0", "tx1", "ty1"))).alias("_tables"))


def _covers(box: g.Box, x: Column, share: float) -> Column:
    return F.round(g.iou(box, [x["tx0"], x["ty0"], x["tx1"], x["ty1"]]), 3) >= share


def with_tables(blocks: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """blocks with table_id, the first table that each covers (IoU 0.5), and in_table, whether it fits one closely (IoU 0.7)."""
    j = blocks.join(_of_page(tables, keys), keys, "left")
    first = F.get(F.filter("_tables", lambda x: _covers(g.box(), x, 0.5)), F.lit(0))["table_id"]
    return j.withColumn("table_id", first).withColumn("in_table", F.coalesce(F.exists("_tables", lambda x: _covers(g.box(), x, 0.7)), F.lit(False))).drop("_tables")


def confidence(cells: Column, alignment: Column, in_table: Column, box: g.Box) -> Column:
    """Cells, alignment, density, cells by height and a table's support in one number, to 3 places."""
    height, surface = box[3] - box[1], (box[2] - box[0]) * (box[3] - box[1])
    capped = lambda value, most: F.least(F.lit(1.0), value / most)
    dense = F.when(surface > 0, capped(cells / surface, 5e-4)).otherwise(0.0)
    tall = F.when(height > 0, capped(cells / height, 0.1)).otherwise(0.0)
    return F.round(0.25 * capped(cells, 20) + 0.25 * alignment + 0.15 * dense + 0.15 * tall + F.when(in_table, 0.2).otherwise(0.0), 3)


def drop_weak(blocks: DataFrame, keys: list[str], ident: str = "block_id", t: Limits = Limits()) -> DataFrame:
    """blocks (cells, box) without those of few cells for their height that overlap one of more; strength is added."""
    strength = F.when(F.col("y1") > F.col("y0"), F.col("cells") / (F.col("y1") - F.col("y0"))).otherwise(0.0)
    c = blocks.withColumn("strength", strength)
    strong = c.filter(F.col("strength") >= t.min_strength).select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(x).alias(f"{x}_o") for x in ("x0", "y0", "x1", "y1")])
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    weak = same & (F.col("strength") < t.min_strength) & g.meets(g.box(suffix="_o"), g.box()) & (F.round(g.iou(g.box(suffix="_o"), g.box()), 3) > t.weak_iou)
    return c.join(strong, weak, "left_anti")


STAGES = ("initial_count", "after_confidence", "after_merging", "after_nesting", "after_weak_filter", "final_count", "removed_count", "merged_count")


def refine_page(blocks: list[dict], tables: list, t: Limits = Limits(), compat: bool = False) -> tuple[list[dict], dict[str, int]]:
    """Blocks {block_id, bbox, cells, alignment, share} scored, merged, freed of nested and weak ones; and counts by stage.

    compat: blocks without listed cells count as empty.
    """
    size = (lambda b: 0) if compat else (lambda b: b["cells"])
    score = lambda b: kernels.block_confidence(b["bbox"], size(b), b["share"], tables)
    now = [b | {"merged_from": [b["block_id"]], "confidence": score(b)} for b in blocks]
    counts = {"initial_count": len(now), "after_confidence": len(now)}
    now = kernels.merge_adjacent(now, t.max_gap, t.center_tolerance, tables)
    now = [b if b["confidence"] is not None else b | {"confidence": score(b)} for b in now]
    counts["after_merging"] = len(now)
    keep = kernels.drop_nested([b["bbox"] for b in now], [b["confidence"] for b in now], t.overlap_ratio, t.area_ratio, t.confidence_difference)
    now = [b for b, k in zip(now, keep, strict=True) if k]
    counts["after_nesting"] = len(now)
    keep = kernels.drop_weak([b["bbox"] for b in now], [size(b) for b in now], t.min_strength, t.weak_iou)
    now = [b for b, k in zip(now, keep, strict=True) if k]
    counts |= {"after_weak_filter": len(now), "final_count": len(now)}
    return now, counts | {"removed_count": counts["initial_count"] - len(now), "merged_count": counts["initial_count"] - counts["after_merging"]}


def refine(blocks: DataFrame, tables: DataFrame, keys: list[str], t: Limits = Limits(), compat: bool = False) -> DataFrame:
    """(keys, block_id, box, cells, alignment, share, confidence, merged_from, stages): refined blocks of each page.

    blocks: block_id, x0, y0, x1, y1, cells, alignment ('left', 'right', ...), share (of cells on the block's baseline).
    stages: the page's counts after each step.
    """
    kinds = dict(blocks.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block_id long, x0 double, y0 double, x1 double, y1 double, cells long, alignment string, share double, confidence double, merged_from array<long>, stages map<string, int>"

    names = ["block_id", "x0", "y0", "x1", "y1", "cells", "alignment", "share", "confidence", "merged_from", "stages"]
    types = [pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.int32())]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, of = [], []
        for k, (listed, of_page) in enumerate(zip(batch.column("rows").to_pylist(), batch.column("_tables").to_pylist(), strict=True)):
            tables = [(x["tx0"], x["ty0"], x["tx1"], x["ty1"]) for x in of_page or []]
            rows = [{"block_id": r["block_id"], "bbox": (r["x0"], r["y0"], r["x1"], r["y1"]), "cells": r["cells"], "alignment": r["alignment"], "share": r["share"]} for r in listed]
            found, counts = refine_page(rows, tables, t, compat)
            out += [(b["block_id"], *b["bbox"], b["cells"], b["alignment"], b["share"], b["confidence"], b["merged_from"], list(counts.items())) for b in found]
            of += [k] * len(found)
        columns = [pa.array([r[c] for r in out], kind) for c, kind in enumerate(types)]
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of, pa.int64())) for k in keys), *columns], [*keys, *names])

    slim = blocks.select(*keys, F.col("block_id").cast("long").alias("block_id"), "x0", "y0", "x1", "y1", F.col("cells").cast("long").alias("cells"), "alignment", "share")
    return kernels.many_pages(kernels.packed_pages(slim, keys, "block_id").join(_of_page(tables, keys), keys, "left"), kernel, schema)
