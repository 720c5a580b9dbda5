"""Alignment baselines of a page: edges that many cells share, merged, scored and filtered.

clusters() and detect() look at the sorted rows of many whole pages at a time; only the chain merge of vertical baselines and
the greedy suppression of horizontal ones go one by one. scored() and what follows are column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import geometry as g
from folioscan.operators import kernels


@dataclass(frozen=True)
class Limits:
    """Fixed values of the detection, in points unless they are counts or shares."""

    weight_cap: int = 6
    block_distance: float = 2.0
    min_weight: float = 3.0
    min_horizontal: int = 2
    merge_distance: float = 3.0
    merge_overlap: float = 0.30
    block_coverage: float = 0.20
    proximity: float = 5.0
    spread: float = 50.0
    full_support: float = 10.0
    edge_margin: float = 50.0
    min_confidence: float = 0.03
    min_support: float = 1.0
    mid_page_coverage: float = 0.0
    min_consistency: float = 0.0


SIDES = {"left": "x0", "right": "x1", "top": "y0", "bottom": "y1"}
_BY_NAME = sorted(SIDES)
_ACROSS = ("left", "right")


def added(lo: Column, hi: Column, keys: list[str]) -> Column:
    """What a span adds to the union of the spans before it, by lo and hi, among rows of equal keys; the sum is the union's length."""
    ahead = Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    return F.greatest(F.lit(0.0), hi - F.greatest(lo, F.coalesce(F.max(hi).over(ahead), lo)))


def union_of_spans(rows: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(keys, covered, runs): length of the union of the spans of equal keys, and how many stretches it has (touching ones are one)."""
    ahead = Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col(lo) > F.max(hi).over(ahead), F.lit(True))
    placed = rows.select(*keys, lo, hi).withColumn("_new", new.cast("int")).withColumn("_added", added(F.col(lo), F.col(hi), keys))
    return placed.groupBy(*keys).agg(F.sum("_added").alias("covered"), F.sum("_new").alias("runs"))


def _rows(cells: DataFrame, keys: list[str], blocks: DataFrame | None, t: Limits, ident: str | None = None) -> DataFrame:
    """Cells, and blocks with their weight, as rows of one table."""
    sides = [F.col(c).cast("double").alias(c) for c in SIDES.values()]
    rows = cells.select(*keys, *sides, F.lit(1).cast("long").alias("w"), F.lit(False).alias("block"), *([ident] if ident else []))
    if blocks is None:
        return rows
    weight = F.least(F.lit(t.weight_cap), F.greatest(F.lit(1), "line_count")).cast("long").alias("w")
    return rows.unionByName(blocks.select(*keys, *sides, weight, F.lit(True).alias("block")), allowMissingColumns=True)


def _near_blocks(page: np.ndarray, edge: np.ndarray, block: np.ndarray, distance: float) -> np.ndarray:
    """Whether an edge lies near that of a block of its page, or there are no blocks."""
    near = np.ones(len(page), bool)
    for of in np.unique(page[block]).tolist():
        a, b = np.searchsorted(page, [of, of + 1])
        seeds, e = edge[a:b][block[a:b]], edge[a:b]
        seeds = np.sort(seeds[~np.isnan(seeds)])
        at = np.searchsorted(seeds, e)
        met = [np.abs(seeds[np.clip(k, 0, len(seeds) - 1)] - e) <= distance for k in (at - 1, at)] if len(seeds) else [np.zeros(b - a, bool)]
        near[a:b] = block[a:b] | np.logical_or.reduce(met)
    return near


def _furthest(ends: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The largest end of the rows before each one in its group, given the places in the group; -inf for the first."""
    most, step, longest = ends.copy(), 1, int(place.max(initial=0))
    while step < longest:
        most[step:] = np.where(place[step:] >= step, np.maximum(most[step:], most[:-step]), most[step:])
        step *= 2
    return np.where(place > 0, np.concatenate(([-np.inf], most[:-1])), -np.inf)


def _half_up(x: np.ndarray, places: int) -> np.ndarray:
    """Rounded as Spark does: a half of the shortest decimal goes up."""
    raised = x * 10.0**places + 0.5
    out = np.floor(raised) / 10.0**places
    for i in np.flatnonzero(np.abs(raised - np.rint(raised)) < 1e-6).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return out


def _clustered(page: np.ndarray, rows: pa.RecordBatch, width: float, height: float, t: Limits, ident: str | None = None) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(clusters, edges) of whole pages. Cluster c has the edges from first[c] to last[c], by their beginning (then ident); a side that is
    unknown counts as an edge of its own, without a place. Of edges with blocks among them only those of blocks are `spans`."""
    own = {c: rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in SIDES.values()}
    w, block = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("w", "block"))
    number = np.arange(len(page))
    if ident:
        number = np.empty(len(page), np.int64)
        number[pc.sort_indices(rows.column(ident), null_placement="at_start").to_numpy()] = np.arange(len(page))
    seeded = np.zeros(int(page.max(initial=0)) + 1, bool)
    seeded[page[block]] = True
    clusters, edges, ahead = [], [], 0
    for code, side in enumerate(_BY_NAME):
        across = side in _ACROSS
        edge, (p, q) = own[SIDES[side]], (own[c] for c in (("y0", "y1") if across else ("x0", "x1")))
        at = np.flatnonzero(_near_blocks(page, edge, block, t.block_distance) if across else ~block)
        if not len(at):
            continue
        begins = np.fmin(p[at], q[at])
        bucket = np.rint(edge[at]) + 0.0
        at = at[np.lexsort((number[at], np.where(np.isnan(begins), -np.inf, begins), bucket, page[at]))]
        of, edge, lo, hi, centre, weight, is_block = page[at], edge[at], np.fmin(p[at], q[at]), np.fmax(p[at], q[at]), (p[at] + q[at]) / 2, w[at], block[at]
        bucket = np.rint(edge) + 0.0
        new = np.ones(len(at), bool)
        new[1:] = (of[1:] != of[:-1]) | ((bucket[1:] != bucket[:-1]) & ~(np.isnan(bucket[1:]) & np.isnan(bucket[:-1])))
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        place = np.arange(len(at)) - first[group]
        of_block = np.logical_or.reduceat(is_block, first)
        span = (is_block | ~of_block[group]) & ~np.isnan(lo)
        more = np.where(span, np.maximum(0.0, hi - np.maximum(lo, _furthest(np.where(span, hi, -np.inf), place))), 0.0)
        total = lambda x: np.add.reduceat(x, first)
        placed = ~np.isnan(centre)
        some = total(placed.astype(np.int64)) > 0
        count, n = total(weight), np.diff(np.append(first, len(at)))
        value = total(edge * weight) / count
        extent = width if across else height
        names = ("page_left", "mid_page", "page_right") if across else ("page_top", "mid_page", "page_bottom")
        c = {
            "page": of[first], "side": np.full(len(first), code), "bucket": bucket[first], "value": value, "count": count, "block_support": total(np.where(is_block, weight, 0)), "seeded": seeded[of[first]],
            "coverage": _half_up(np.minimum(1.0, total(more) / (height if across else width)), 3), "page_position": np.where(value < extent * 0.25, names[0], np.where(value > extent * 0.75, names[2], names[1])),
            "s0": count, "s1": np.where(some, total(np.where(placed, weight * centre, 0.0)), np.nan), "s2": np.where(some, total(np.where(placed, weight * centre * centre, 0.0)), np.nan), "first": first + ahead, "last": first + n + ahead,
        }
        enough = (count >= t.min_weight) & (~c["seeded"] | (c["block_support"] > 0)) if across else n >= t.min_horizontal
        clusters.append({k: x[enough] for k, x in c.items()})
        edges.append({"row": at, "lo": lo, "hi": hi, "span": span, "block": is_block})
        ahead += len(at)
    return tuple({k: np.concatenate([x[k] for x in parts]) for k in parts[0]} for parts in (clusters, edges))


def clusters(cells: DataFrame, keys: list[str], blocks: DataFrame | None = None, width: float = 612.0, height: float = 792.0, t: Limits = Limits(), ident: str | None = None, keep: int = 30) -> DataFrame:
    """Edges rounded to a point, with weight, mean, coverage and the sums that consistency needs.

    blocks (x0, y0, x1, y1, line_count) weigh in on the left and right sides by their lines. On a page that has blocks,
    a cell's left or right edge counts only near a block's, and a cluster only if a block is in it. ident: samples, too,
    the first `keep` cells, by place along the edge. With `judged` that is what speaks for those retained and those turned down alike.
    """
    kinds = dict(cells.dtypes)
    names = "side string, bucket double, count long, value double, block_support long, seeded boolean, s0 long, s1 double, s2 double, coverage double, page_position string"
    plain = [c.split()[0] for c in names.split(", ")]

    def kernel(page: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
        c, e = _clustered(page, rows, width, height, t, ident)
        begins = np.flatnonzero(np.diff(page, prepend=-1))
        arrays = {k: rows.column(k).take(pa.array(begins[c["page"]])) for k in keys} | {k: pa.array(c[k], from_pandas=True) for k in plain} | {"side": pa.array(_BY_NAME).take(pa.array(c["side"]))}
        if ident:
            cell = np.concatenate(([0], np.cumsum(~e["block"])))
            n = np.minimum(cell[c["last"]] - cell[c["first"]], keep)
            ends = np.concatenate(([0], np.cumsum(n)))
            of = e["row"][~e["block"]][np.repeat(cell[c["first"]] - ends[:-1], n) + np.arange(ends[-1])]
            arrays["samples"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows.column(ident).take(pa.array(of)))
        return pa.RecordBatch.from_pydict(arrays)

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), names, *([f"samples array<{kinds[ident]}>"] if ident else [])])
    return kernels.whole_pages(_rows(cells, keys, blocks, t, ident), keys, kernel, schema)


_BASELINE = "side string, value double, page_position string, count long, block_support long, coverage double, s0 long, s1 double, s2 double"


def detect(cells: DataFrame, keys: list[str], blocks: DataFrame | None = None, width: float = 612.0, height: float = 792.0, t: Limits = Limits(), compat: bool = False) -> DataFrame:
    """(keys, side, value, page_position, count, block_support, coverage, s0, s1, s2, rank): the baselines of each page.

    Left and right ones near each other are chained together where their spans overlap; with blocks, those in mid-page
    that cover little go; of top and bottom ones near each other the fullest stays. rank: by falling count, then value.
    compat: right baselines have neither spans nor coverage.
    """
    kinds = dict(cells.dtypes)
    names = [c.split()[0] for c in _BASELINE.split(", ")]
    right = _BY_NAME.index("right")

    def kernel(page: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
        begins = np.flatnonzero(np.diff(page, prepend=-1))
        now, edges = _clustered(page, rows, width, height, t)
        order = np.lexsort((now["side"], np.where(np.isnan(now["value"]), -np.inf, now["value"]), now["page"]))
        now = {c: x[order] for c, x in now.items()}
        page = now["page"]
        across = np.isin(now["side"], [_BY_NAME.index(s) for s in _ACROSS])
        if compat:
            now["coverage"][now["side"] == right] = 0.0
        keep, upright = across.copy(), np.flatnonzero(across)
        # only neighbours of one side and within the distance can be chained, as a chain's value is never above its last one's
        linked = (np.diff(page[upright]) == 0) & (np.diff(now["side"][upright]) == 0) & (np.diff(now["value"][upright]) <= t.merge_distance)
        runs = np.flatnonzero(np.diff(np.concatenate(([False], linked, [False]))))
        for first, last in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
            run = upright[first : last + 1].tolist()
            parts = []
            for r in run:
                part = {c: now[c][r] if c == "page_position" else now[c][r].item() for c in names} | {"row": r, "spans": []}
                if not (compat and part["side"] == right):
                    a, b = now["first"][r], now["last"][r]
                    on = edges["span"][a:b]
                    part["spans"] = list(zip(edges["lo"][a:b][on].tolist(), edges["hi"][a:b][on].tolist(), strict=True))
                parts.append(part)
            keep[run] = False
            for part in kernels.chain_merge(parts, t.merge_distance, t.merge_overlap):
                if part.get("merged"):
                    part["coverage"] = round(min(1.0, sum(b - a for a, b in kernels.merge_spans(part["spans"])) / height), 3)
                keep[part["row"]] = True
                for c in names:
                    now[c][part["row"]] = part[c]
        keep &= ~(now["seeded"] & (now["coverage"] < t.block_coverage) & (now["page_position"] == "mid_page"))
        level = np.flatnonzero(~across)
        for of in np.split(level, np.flatnonzero(np.diff(page[level])) + 1):
            keep[of] = kernels.suppress_near(now["value"][of], now["count"][of], t.proximity)
        now = {c: now[c][keep] for c in ("page", *names)}
        page = now["page"]
        order = np.lexsort((now["side"], np.where(np.isnan(now["value"]), -np.inf, now["value"]), -now["count"], page))
        rank = np.empty(len(page), np.int32)
        rank[order] = np.arange(len(page)) - np.searchsorted(page, page[order]) + 1
        arrays = {k: rows.column(k).take(pa.array(begins[page])) for k in keys} | {c: pa.array(now[c], from_pandas=True) for c in names}
        return pa.RecordBatch.from_pydict(arrays | {"side": pa.array(_BY_NAME).take(pa.array(now["side"])), "rank": pa.array(rank)})

    return kernels.whole_pages(_rows(cells, keys, blocks, t), keys, kernel, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + _BASELINE + ", rank int")


def consistency(t: Limits = Limits()) -> Column:
    """1 less the standard deviation along the baseline over `spread`; 1 for fewer than two values."""
    mean = F.col("s1") / F.col("s0")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("s0") - mean * mean))
    return F.when(F.col("s0") < 2, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - deviation / t.spread), 3))


def scored(baselines: DataFrame, width: float = 612.0, height: float = 792.0, t: Limits = Limits()) -> DataFrame:
    """baselines with consistency, edge_proximity and confidence (up to 1.1)."""
    s = baselines.withColumn("consistency", consistency(t)).withColumn("_e", g.edge_proximity(F.col("value"), F.when(F.col("side").isin("left", "right"), width).otherwise(height)))
    support = F.least(F.lit(1.0), (F.col("count") + 0.5 * F.col("block_support")) / t.full_support)
    confidence = 0.4 * support + 0.3 * F.col("coverage") + 0.2 * F.col("consistency") + F.when(F.col("_e") <= t.edge_margin, 0.2).otherwise(0.0)
    # the terms have few decimals: rounded twice, a half isn't left to the last bit of a sum
    return s.withColumn("confidence", F.round(F.round(confidence, 9), 3)).withColumn("edge_proximity", F.round("_e", 2)).drop("_e")


def judged(baselines: DataFrame, width: float = 612.0, height: float = 792.0, t: Limits = Limits()) -> DataFrame:
    """Scored baselines with the reasons against them; one without reasons is retained."""
    s = scored(baselines, width, height, t)
    mid = F.col("side").isin("left", "right") & (F.col("page_position") == "mid_page") & (F.col("coverage") < t.mid_page_coverage)
    reasons = [
        (F.col("confidence") < t.min_confidence, F.format_string(f"low_confidence (%.3f < {t.min_confidence})", "confidence")),
        (F.col("count") < t.min_support, F.format_string(f"low_support (%d < {t.min_support})", "count")),
        (mid, F.format_string(f"low_coverage_mid_page (%.3f < {t.mid_page_coverage})", "coverage")),
        (F.col("consistency") < t.min_consistency, F.format_string(f"low_consistency (%.3f < {t.min_consistency})", "consistency")),
    ]
    return s.withColumn("reasons", F.array_compact(F.array(*[F.when(c, r) for c, r in reasons]))).withColumn("retained", F.size("reasons") == 0)


def refine(baselines: DataFrame, keys: list[str], width: float = 612.0, height: float = 792.0, t: Limits = Limits()) -> DataFrame:
    """The retained baselines; rank: by falling confidence, then count, then as before."""
    kept = judged(baselines, width, height, t).filter("retained").drop("reasons", "retained")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), F.desc("count"), "rank")))

