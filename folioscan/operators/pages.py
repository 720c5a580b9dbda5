"""Two tables of boxes met page by page, with one shuffle of packed rows.

Rows of a page that stand together in their table are packed into one row of arrays before the shuffle, whose numbers
repeat and compress; a page's rows meet in a kernel that deals boxes into bins, as spatial does, so that the comparisons
follow the neighbours of a box and not the square of the page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from folioscan.operators import kernels
from folioscan.operators.spatial import BINS, COORDS

#: Comparisons made at once.
_AT_ONCE = 1 << 20


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with every column but the keys as an array, one row for each run of equal keys in a batch."""
    others = [c for c in rows.columns if c not in keys]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in keys:
                c = batch.column(k)
                new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            offsets = pa.array(np.append(first, batch.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(first)) for k in keys), *lists], [*keys, *others])

    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([StructField(k, kinds[k]) for k in keys] + [StructField(c, ArrayType(kinds[c])) for c in others])
    return rows.select(*keys, *others).mapInArrow(pack, schema)


def _dealt(boxes: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the box, bin along x, bin along y) of every bin that a box touches; boxes with unknown sides touch none."""
    known = np.flatnonzero(np.isfinite(boxes).all(axis=1))
    ends = np.floor(boxes[known] / np.tile(bins, 2)).astype(np.int64)
    low = np.minimum(ends[:, :2], ends[:, 2:])
    size = np.maximum(ends[:, :2], ends[:, 2:]) - low + 1
    counts = size[:, 0] * size[:, 1]
    row = np.repeat(np.arange(len(known)), counts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return known[row], low[row, 0] + k % size[row, 0], low[row, 1] + k // size[row, 0]


def meeting(a: np.ndarray, b: np.ndarray, bins: tuple[float, float] | None = BINS, pages: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), in order, of all boxes of a and of b that overlap strictly; a pair is judged in the bin where its intersection begins.

    pages: the page of each box of a and of b, as numbers from 0, where they are of several.
    """
    step = np.array(bins or (np.inf, np.inf))
    (ra, xa, ya), (rb, xb, yb) = _dealt(a, step), _dealt(b, step)
    none = np.zeros(0, np.int64)
    if not len(ra) or not len(rb):
        return none, none
    spans = [(min(int(p.min()), int(q.min())), max(int(p.max()), int(q.max()))) for p, q in ((xa, xb), (ya, yb))]
    wide, high = (hi - lo + 1 for lo, hi in spans)
    n_pages = 1 + max(int(pages[0].max()), int(pages[1].max())) if pages is not None else 1
    if wide * high * n_pages < 2**62:
        ca, cb = ((x - spans[0][0]) * high + (y - spans[1][0]) for x, y in ((xa, ya), (xb, yb)))
    else:  # bins go by rank, so that the numbers of far ones don't outgrow 64 bits
        (cols, x), (lines, y) = (np.unique(np.concatenate(c), return_inverse=True) for c in ((xa, xb), (ya, yb)))
        wide, high = len(cols), len(lines)
        code = x * high + y
        ca, cb = code[: len(ra)], code[len(ra) :]
    if pages is not None:
        ca, cb = ca + pages[0][ra] * (wide * high), cb + pages[1][rb] * (wide * high)
    order = np.argsort(cb, kind="stable")
    cb, rb = cb[order], rb[order]
    # where a box begins: an intersection begins where either does, and the other box has begun
    at_a, at_b = (np.floor(v[:, :2] / step)[r] for v, r in ((a, ra), (b, rb)))
    here_a, here_b = np.stack([xa, ya], axis=1), np.stack([xb[order], yb[order]], axis=1)
    first_a, first_b = ((v == h).view(np.uint8) @ np.array([1, 2], np.uint8) for v, h in ((at_a, here_a), (at_b, here_b)))
    begun_a, begun_b = ((v <= h).all() for v, h in ((at_a, here_a), (at_b, here_b)))
    lo, hi = np.searchsorted(cb, ca, "left"), np.searchsorted(cb, ca, "right")
    total, out, at = np.concatenate(([0], np.cumsum(hi - lo))), [], 0
    while at < len(ca):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + _AT_ONCE, "right")) - 1)
        n = hi[at:stop] - lo[at:stop]
        m = np.repeat(np.arange(at, stop), n)
        k = lo[m] + np.arange(len(m)) - np.repeat(np.cumsum(n) - n, n)
        some = np.flatnonzero((first_a[m] | first_b[k]) == 3)
        m, k = m[some], k[some]
        if not (begun_a and begun_b):  # a box whose sides are crossed lies in bins before its beginning
            some = ((at_a[m] <= here_a[m]) & (at_b[k] <= here_b[k])).all(axis=1)
            m, k = m[some], k[some]
        i, j = ra[m], rb[k]
        p, q = a[i], b[j]
        ok = (p[:, 0] < q[:, 2]) & (q[:, 0] < p[:, 2]) & (p[:, 1] < q[:, 3]) & (q[:, 1] < p[:, 3])
        out.append((i[ok], j[ok]))
        at = stop
    i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((j, i))
    return i[order], j[order]


def iou(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """geometry.iou of rows of boxes, in the same steps."""
    area = lambda x: np.maximum(0.0, x[:, 2] - x[:, 0]) * np.maximum(0.0, x[:, 3] - x[:, 1])
    shared = np.maximum(0.0, np.minimum(p[:, 2], q[:, 2]) - np.maximum(p[:, 0], q[:, 0])) * np.maximum(0.0, np.minimum(p[:, 3], q[:, 3]) - np.maximum(p[:, 1], q[:, 1]))
    below = area(p) + area(q) - shared
    return np.divide(shared, below, out=np.zeros_like(shared), where=below > 0)


def columns_of(table: pa.Table, names: list[str]) -> dict[str, pa.Array]:
    """The arrays of packed rows in a row."""
    flat = {}
    for c in names:
        parts = [x.flatten() for x in table.column(c).chunks]
        flat[c] = pa.concat_arrays(parts) if parts else pa.array([], table.schema.field(c).type.value_type)
    return flat


def boxes_of(flat: dict[str, pa.Array]) -> np.ndarray:
    return np.stack([flat[c].to_numpy(zero_copy_only=False).astype(float) for c in COORDS], axis=1)


def best(boxes: DataFrame, items: DataFrame, min_iou: float, keys: list[str], ident: str, item: str, bins: tuple[float, float] | None = BINS) -> DataFrame:
    """boxes with the item (sx0, sy0, sx1, sy1) of their page of the largest IoU >= min_iou, the first of equals, and match_iou; null without one. Many pages at a time."""
    sides = ("sx0", "sy0", "sx1", "sy1")
    own = [ident, *(c for c in boxes.columns if c not in (*keys, ident, item, "match_iou"))]
    a = boxes.select(*keys, *own).withColumn("_box", F.lit(True))
    b = items.select(*keys, F.col(item).alias("_item"), *[F.col(c).alias(f"_{c}") for c in sides]).withColumn("_box", F.lit(False))
    packed = kernels.packed_pages(a.unionByName(b, allowMissingColumns=True), keys)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        page, rows = kernels.rows_of(batch.column("rows"))
        is_box = rows["_box"].to_numpy(zero_copy_only=False).astype(bool)
        mine, other = np.flatnonzero(is_box), np.flatnonzero(~is_box)
        for k in keys:  # a page without a key meets none
            other = other[batch.column(k).is_valid().to_numpy(zero_copy_only=False)[page[other]]]
        sides_of = lambda names, at: np.stack([rows[c].to_numpy(zero_copy_only=False).astype(float)[at] for c in names], axis=1)
        p, q = sides_of(COORDS, mine), sides_of([f"_{c}" for c in sides], other)
        i, j = meeting(p, q, bins, (page[mine], page[other]))
        v = iou(p[i], q[j])
        i, j, v = (x[v >= min_iou] for x in (i, j, v))
        number = rows["_item"].take(pa.array(other[j]))
        order = np.lexsort((number.to_numpy(zero_copy_only=False), -v, i))
        order = order[np.diff(i[order], prepend=-1) > 0]
        at = np.full(len(mine), -1)
        at[i[order]] = order
        some = pa.array(at, mask=at < 0)
        where = pa.array(mine)
        columns = [*(batch.column(k).take(pa.array(page[mine])) for k in keys), *(rows[c].take(where) for c in own), number.take(some), pa.array(v).take(some)]
        return pa.RecordBatch.from_arrays(columns, [*keys, *own, item, "match_iou"])

    kinds = {**{f.name: f.dataType for f in boxes.schema.fields}, item: items.schema[item].dataType, "match_iou": DoubleType()}
    return kernels.many_pages(packed, kernel, StructType([StructField(c, kinds[c]) for c in [*keys, *own, item, "match_iou"]]))


def inside(page: np.ndarray, boxes: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, k), in order of k, of boxes i that lie inside another box k of their page, up to the tolerance.

    A box meets those whose top lies between its own top and bottom; one whose top lies below its bottom meets its page.
    """
    n = len(boxes)
    top, bottom = boxes[:, 1], boxes[:, 3]
    _, ranks = np.unique(np.concatenate([top, top - tolerance, bottom + tolerance]), return_inverse=True)
    wide = 3 * n + 1
    odd = ~(top <= bottom)
    usual, strange = np.flatnonzero(~odd), np.flatnonzero(odd)
    key = page * wide + ranks[:n]
    usual = usual[np.argsort(key[usual], kind="stable")]
    strange = strange[np.argsort(page[strange], kind="stable")]
    at = np.arange(n)
    reaches = [
        (usual, np.searchsorted(key[usual], page * wide + ranks[n : 2 * n], "left"), np.searchsorted(key[usual], page * wide + ranks[2 * n :], "right")),
        (strange, np.searchsorted(page[strange], page, "left"), np.searchsorted(page[strange], page, "right")),
    ]
    found = []
    for members, lo, hi in reaches:
        counts = np.maximum(hi - lo, 0)
        total, first = np.concatenate(([0], np.cumsum(counts))), 0
        while first < n:
            stop = max(first + 1, int(np.searchsorted(total, total[first] + _AT_ONCE, "right")) - 1)
            k = np.repeat(at[first:stop], counts[first:stop])
            i = members[lo[k] + np.arange(len(k)) - (total[k] - total[first])]
            p, q = boxes[i], boxes[k]
            ok = (i != k) & (p[:, 0] >= q[:, 0] - tolerance) & (p[:, 1] >= q[:, 1] - tolerance) & (p[:, 2] <= q[:, 2] + tolerance) & (p[:, 3] <= q[:, 3] + tolerance)
            found.append((i[ok], k[ok]))
            first = stop
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (at, at)


def consolidated(page: np.ndarray, boxes: np.ndarray, texts: pa.Array, tolerance: float = 0.5) -> np.ndarray:
    """kernels.consolidate_exact of many pages: only boxes that lie inside others of their page are judged one by one."""
    areas = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    place = np.empty(len(areas), np.int64)
    place[np.argsort(-areas, kind="stable")] = np.arange(len(areas))
    i, k = inside(page, boxes, tolerance)
    earlier = place[k] < place[i]
    i, k = i[earlier], k[earlier]
    order = np.argsort(place[i], kind="stable")
    keep = np.ones(len(areas), bool)
    a, b = (texts.take(pa.array(x[order])).to_pylist() for x in (i, k))
    for x, y, s, t in zip(i[order].tolist(), k[order].tolist(), a, b, strict=True):
        if keep[x] and keep[y] and s is not None and t is not None and s.lower() in t.lower():
            keep[x] = False
    return keep
