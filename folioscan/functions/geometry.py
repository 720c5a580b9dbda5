"""Box geometry as column expressions. A box is four columns x0, y0, x1, y1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def box(prefix: str = "", suffix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}{suffix}") for c in ("x0", "y0", "x1", "y1")]


def span_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share, 0 if they only touch."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    return span_overlap(a[0], a[2], b[0], b[2]) * span_overlap(a[1], a[3], b[1], b[3])


def ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator isn't positive."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    i = intersection(a, b)
    return ratio(i, area(a) + area(b) - i)


def overlap_score(a: Box, b: Box, mode: str) -> Column:
    """The intersection over the union ('iou'), the smaller box ('min'), the first ('a') or the second ('b')."""
    i = intersection(a, b)
    below = {"iou": area(a) + area(b) - i, "min": F.least(area(a), area(b)), "a": area(a), "b": area(b)}
    return ratio(i, below[mode])


def overlap_metrics(a: Box, b: Box) -> dict[str, Column]:
    """Areas to 2 places, ratios to 3."""
    i = intersection(a, b)
    return {
        "intersection_area": F.round(i, 2),
        "union_area": F.round(area(a) + area(b) - i, 2),
        "iou": F.round(iou(a, b), 3),
        "overlap_ratio_1": F.round(ratio(i, area(a)), 3),
        "overlap_ratio_2": F.round(ratio(i, area(b)), 3),
    }


def meets(a: Box, b: Box) -> Column:
    """Strict overlap; the cheap range tests come first and short-circuit."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def contains(outer: Box, inner: Box, tolerance: float = 0.0) -> Column:
    return (inner[0] >= outer[0] - tolerance) & (inner[1] >= outer[1] - tolerance) & (inner[2] <= outer[2] + tolerance) & (inner[3] <= outer[3] + tolerance)


def overlap_vertically(a: Box, b: Box, tolerance: float = 5.0) -> Column:
    return (a[1] <= b[3] + tolerance) & (b[1] <= a[3] + tolerance)


def from_quad(xs: Sequence[Column], ys: Sequence[Column]) -> list[Column]:
    """The box around a rotated quadrilateral."""
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def from_corners(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """A box whose corners may be given in either order."""
    return [F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)]


def flip(b: Box, page_height: Column) -> list[Column]:
    """Between top-left and bottom-left origin."""
    return [b[0], page_height - b[3], b[2], page_height - b[1]]


def is_zero(b: Box, eps: float = 1e-6) -> Column:
    return (F.abs(b[0]) <= eps) & (F.abs(b[1]) <= eps) & (F.abs(b[2]) <= eps) & (F.abs(b[3]) <= eps)


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def edge_proximity(value: Column, extent: Column) -> Column:
    """Distance to the nearer page edge, infinity without an extent."""
    return F.when(extent.isNull(), F.lit(float("inf"))).otherwise(F.least(F.abs(value), F.abs(extent - value)))


def page_position(value: Column, extent: Column, names: tuple[str, str, str] = ("top", "middle", "bottom")) -> Column:
    return F.when(extent.isNull(), "unknown").when(value < extent * 0.25, names[0]).when(value > extent * 0.75, names[2]).otherwise(names[1])


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def packed_color(r: Column, g: Column, b: Column) -> Column:
    return r * 65536 + g * 256 + b


def unpack_color(c: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(c, 16).bitwiseAND(255), F.shiftright(c, 8).bitwiseAND(255), c.bitwiseAND(255)


def is_regular(value: Column, tolerance: float = 1e-4) -> Column:
    """Whether the fraction, to 4 places, is a quarter."""
    fraction = F.round(value, 4) - F.floor(F.round(value, 4))
    near = [F.abs(fraction - q) <= tolerance for q in (0.0, 0.25, 0.5, 0.75)]
    return near[0] | near[1] | near[2] | near[3]


def upper_median(values: Column) -> Column:
    """Of an array: the element in the middle, the upper one of two."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))
