"""How text looks: colours, gradients and texture of rasters, and the enhanced record of each matched cell.

Rasters come as data (height, width, pixels in rows, grey or RGB, 0 to 255); drawing pages is done elsewhere. Statistics
are numpy functions of one raster; features() applies them to a table in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators.outliers import kmeans

#: The features of a cell in their order, by source.
FEATURES = (
    "fg_luminance", "fg_decimal", "bg_luminance", "bg_decimal", "text_to_bg_ratio",
    "mean_grad", "std_grad", "q1_grad", "median_grad", "q3_grad", "p95_grad", "p99_grad", "max_grad",
    "high_freq", "low_freq", "high_to_low",
    "lap_mean", "lap_std", "lap_max", "lap_p95", "lap_zero_crossings",
    "lv_mean", "lv_std", "lv_max",
    "bil_diff_mean", "bil_edge_pres",
)
RATIO_CAP = 1000.0


def crop(raster: np.ndarray, box: tuple[float, float, float, float], page_height: float, dpi: float, bottom_left: bool = True) -> np.ndarray:
    """The pixels of a box given in points, from the raster of its whole page."""
    scale = dpi / 72
    x0, y0, x1, y1 = box
    if bottom_left:
        y0, y1 = page_height - y1, page_height - y0
    return raster[max(0, int(y0 * scale)) : max(0, int(np.ceil(y1 * scale))), max(0, int(x0 * scale)) : max(0, int(np.ceil(x1 * scale)))]


def rgb(raster: np.ndarray) -> np.ndarray:
    return np.repeat(raster[:, :, None], 3, axis=2) if raster.ndim == 2 else raster


def luminance(pixels: np.ndarray) -> np.ndarray:
    return 0.299 * pixels[..., 0] + 0.587 * pixels[..., 1] + 0.114 * pixels[..., 2]  # in this order, whatever the shape


def two_colors(raster: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(foreground, background, ratio of their pixels): medians by channel of two clusters.

    The foreground is the cluster of under a tenth of the pixels, if there is one, else the darker one.
    """
    pixels = rgb(raster).reshape(-1, 3).astype(np.float64)
    labels, _ = kmeans(pixels, 2)
    parts = [pixels[labels == k] for k in (0, 1)]
    if not all(len(p) for p in parts):
        return np.median(pixels, axis=0), np.median(pixels, axis=0), 0.0
    shares, colors = [len(p) / len(pixels) for p in parts], [np.median(p, axis=0) for p in parts]
    small = int(np.argmin(shares))
    fg = small if shares[small] < 0.1 else int(np.argmin([luminance(c) for c in colors]))
    return colors[fg], colors[1 - fg], shares[fg] / shares[1 - fg]


def foreground_mask(raster: np.ndarray, foreground: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Pixels nearer to the foreground's colour than to the background's."""
    pixels = rgb(raster).astype(np.float64)
    return np.linalg.norm(pixels - foreground, axis=2) < np.linalg.norm(pixels - background, axis=2)


def _shifted(r: np.ndarray, dy: int, dx: int) -> np.ndarray:
    p = np.pad(r, 1, mode="edge")
    return p[1 + dy : 1 + dy + r.shape[0], 1 + dx : 1 + dx + r.shape[1]]


def sobel(r: np.ndarray) -> np.ndarray:
    """Gradient magnitude."""
    gx = sum(w * (_shifted(r, dy, 1) - _shifted(r, dy, -1)) for dy, w in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(w * (_shifted(r, 1, dx) - _shifted(r, -1, dx)) for dx, w in ((-1, 1), (0, 2), (1, 1)))
    return np.hypot(gx, gy)


def laplacian(r: np.ndarray) -> np.ndarray:
    return _shifted(r, -1, 0) + _shifted(r, 1, 0) + _shifted(r, 0, -1) + _shifted(r, 0, 1) - 4 * r


def zero_crossings(r: np.ndarray) -> int:
    s = np.sign(r)
    return int((s[:, 1:] * s[:, :-1] < 0).sum() + (s[1:] * s[:-1] < 0).sum())


def _windows(r: np.ndarray, size: int) -> np.ndarray:
    h = size // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(r, h, mode="reflect" if min(r.shape) > h else "edge"), (size, size))


def local_variance(r: np.ndarray, size: int = 5) -> np.ndarray:
    return _windows(r, size).var(axis=(2, 3))


def bilateral(r: np.ndarray, size: int = 9, color: float = 75.0, space: float = 75.0) -> np.ndarray:
    """Each pixel as the mean of its window's disc, weighted by nearness in place and in value."""
    near = np.arange(size) - size // 2
    square = near[:, None] ** 2 + near[None, :] ** 2
    place = np.where(square <= (size // 2) ** 2, np.exp(-square / (2 * space**2)), 0.0)
    out = np.empty(r.shape)
    for y, row in enumerate(_windows(r, size)):
        w = place * np.exp(-((row - r[y][:, None, None]) ** 2) / (2 * color**2))
        out[y] = (w * row).sum(axis=(1, 2)) / w.sum(axis=(1, 2))
    return out


def gradient_statistics(grey: np.ndarray, mask: np.ndarray | None = None) -> dict[str, float]:
    """Summary, energies and texture of a grey raster, over the mask where one is given; all 0 if that is empty."""
    grad = sobel(grey)
    values = grad[mask] if mask is not None else grad.ravel()
    names = ("mean", "std", "min", "q1", "median", "q3", "p95", "p99", "max", "mode", "high_freq", "low_freq", "high_to_low_ratio", "lap_mean", "lap_std", "lap_max", "lap_p95", "lap_zero_crossings", "lv_mean", "lv_std", "lv_max", "bil_diff_mean", "bil_edge_pres")
    if not values.size:
        return dict.fromkeys(names, 0.0)
    counts, edges = np.histogram(values, bins=100, range=(values.min(), values.max()))
    top = int(counts.argmax())
    q = np.percentile(values, [25, 50, 75, 95, 99])
    high, low = float(values[values > q[1]].sum()), float(values[values <= q[1]].sum())
    lap, lv, smooth = laplacian(grey), local_variance(grey), bilateral(grey)
    some = lambda x: x[mask] if mask is not None else x.ravel()
    size, var, off = np.abs(some(lap)), some(lv), np.abs(some(grey) - some(smooth))
    kept = some(sobel(smooth)).mean() / values.mean() if values.mean() > 0 else 0.0
    ratio = high / low if low > 0 else (float("inf") if high > 0 else 0.0)
    row = (values.mean(), values.std(), values.min(), *q, values.max(), (edges[top] + edges[top + 1]) / 2, high, low, ratio, size.mean(), size.std(), size.max(), np.percentile(size, 95), zero_crossings(lap), var.mean(), var.std(), var.max(), off.mean(), kept)
    return {n: float(v) for n, v in zip(names, row, strict=True)}


def describe(raster: np.ndarray) -> dict[str, float]:
    """The 26 features of a raster: its two colours, and the gradients of what is in the foreground."""
    raster = np.asarray(raster, np.float64)
    fg, bg, ratio = two_colors(raster)
    g = gradient_statistics(luminance(rgb(raster)), foreground_mask(raster, fg, bg))
    packed = lambda c: float(int(c[0]) * 65536 + int(c[1]) * 256 + int(c[2]))
    row = (
        luminance(fg), packed(fg), luminance(bg), packed(bg), ratio, *(g[k] for k in ("mean", "std", "q1", "median", "q3", "p95", "p99", "max", "high_freq", "low_freq")), min(g["high_to_low_ratio"], RATIO_CAP),
        *(g[k] for k in ("lap_mean", "lap_std", "lap_max", "lap_p95", "lap_zero_crossings", "lv_mean", "lv_std", "lv_max", "bil_diff_mean", "bil_edge_pres")),
    )
    return {n: float(v) for n, v in zip(FEATURES, row, strict=True)}


def as_raster(values, height: int, width: int) -> np.ndarray:
    """Pixels in rows as (height, width) or (height, width, 3); anything else is an error."""
    r = np.asarray(values, np.float64)
    if height > 0 and width > 0 and len(r) == height * width:
        return r.reshape(height, width)
    if height > 0 and width > 0 and len(r) == 3 * height * width:
        return r.reshape(height, width, 3)
    raise ValueError(f"{len(r)} numbers for {height} x {width} pixels")


def features(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """rasters (keys, pixels, height, width) as keys, the features and _error, which says why a raster has none."""
    kinds = dict(rasters.dtypes)
    columns = [*keys, *FEATURES, "_error"]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for r in p.to_dict("records"):
                try:
                    rows.append({k: r[k] for k in keys} | describe(as_raster(r["pixels"], int(r["height"]), int(r["width"]))) | {"_error": None})
                except Exception as e:  # one bad raster is a row with its error
                    rows.append({k: r[k] for k in keys} | {"_error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=columns)

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + ", ".join(f"{c} double" for c in FEATURES) + ", _error string"
    return rasters.select(*keys, "pixels", "height", "width").mapInPandas(batches, schema)


def enhanced_text(cells: DataFrame, spans: DataFrame, rasters: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_ix"), ident: str = "cell_index") -> DataFrame:
    """One row per cell that matches a span and has a text: its span, score and method, the features of its raster, _error.

    rasters: keys, ident, pixels, height, width. A cell without raster has _error "no raster".
    """
    from folioscan.operators import matching

    ks = list(keys)
    matched = matching.match(cells, spans, keys, ident).withColumnRenamed("cell", ident)
    texts = cells.filter(F.trim("text") != "").select(*ks, ident, "text")
    j = texts.join(matched, [*ks, ident])
    looks = features(rasters.join(j.select(*ks, ident), [*ks, ident], "left_semi"), [*ks, ident]).withColumn("_seen", F.lit(True))
    full = j.join(looks, [*ks, ident], "left")
    return full.withColumn("_error", F.when(F.col("_seen").isNull(), "no raster").otherwise(F.col("_error"))).drop("_seen")
