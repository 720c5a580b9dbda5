"""Kernels against the reference cases of FIXTURES.md and against naive versions."""

import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscan.operators import appearance, kernels, outliers


def block(box, alignment="left", cells=1, name=0):
    return {"bbox": box, "alignment": alignment, "cells": cells, "merged_from": [name]}


TABLES = [(100, 200, 250, 216), (90, 218, 250, 236)]


@pytest.mark.parametrize(
    "blocks,n",
    [
        ([block((100, 200, 250, 215)), block((100, 220, 240, 235))], 1),
        ([block((100, 200, 250, 215), "right"), block((110, 220, 250, 235), "right")], 1),
        ([block((100, 200, 250, 215)), block((100, 260, 240, 275))], 2),
        ([block((100, 200, 250, 215)), block((100, 220, 240, 235), "right")], 2),
        ([block((100, 200, 250, 215)), block((300, 220, 450, 235))], 2),
        ([block((100, 500, 250, 515)), block((100, 520, 240, 535))], 1),
        ([block((100, 200, 250, 215)), block((100, 220, 245, 235)), block((100, 240, 250, 255))], 1),
        ([block((0, 0, 9, 9), "center"), block((0, 10, 9, 19), "center")], 2),
    ],
)
def test_merge_adjacent(blocks, n):
    merged = kernels.merge_adjacent(blocks)
    assert len(merged) == n
    assert sum(m["cells"] for m in merged) == len(blocks)


def test_blocks_of_two_tables_stay_apart():
    two = [block((100, 200, 250, 215)), block((100, 220, 240, 235))]
    assert [kernels.table_of(b["bbox"], TABLES) for b in two] == [0, 1]
    assert len(kernels.merge_adjacent(two)) == 1 and len(kernels.merge_adjacent(two, tables=TABLES)) == 2
    assert len(kernels.merge_adjacent(two, tables=[(0, 0, 612, 792)])) == 1


def test_nesting():
    big, small = (0, 0, 400, 400), (100, 100, 200, 200)
    drop = lambda boxes, conf: kernels.drop_nested(np.array(boxes, float), np.array(conf)).tolist()
    assert drop([big, small], [0.85, 0.35]) == [True, False]
    assert drop([big, small], [0.85, 0.8]) == [True, True]
    assert drop([big, (0, 0, 390, 390)], [0.85, 0.35]) == [True, True]
    assert drop([big, (350, 350, 450, 450)], [0.85, 0.35]) == [True, True]
    assert drop([big, small, (10, 10, 50, 50)], [0.9, 0.3, 0.2]) == [True, False, False]
    assert drop([], []) == []


def test_chain_merge_is_broken_by_the_other_side():
    value = lambda side, v, n, *spans: {"side": side, "value": v, "count": n, "spans": list(spans)}
    near = [value("left", 10.0, 2, (0, 100)), value("left", 12.0, 6, (0, 100))]
    assert [(m["value"], m["count"]) for m in kernels.chain_merge(near)] == [(11.5, 8)]
    assert len(kernels.chain_merge([near[0], value("right", 11.0, 1, (0, 100)), near[1]])) == 3
    assert len(kernels.chain_merge([near[0], value("left", 12.0, 6, (200, 300))])) == 2


def test_suppression_and_lines():
    assert kernels.suppress_near(np.array([10.0, 12.0, 20.0]), np.array([1, 5, 1])).tolist() == [False, True, True]
    assert kernels.fold_lines(np.array([0.0, 1.4, 2.0, 2.9, 10.0])).tolist() == [0, 0, 0, 1, 2]


def test_iterative_noise_rules():
    split = lambda y, **k: kernels.split_iteratively(np.zeros(len(y)), np.array(y, float), **k)
    assert split([]) == []
    assert [sorted(b) for b in split([0, 5, 100])] == [[0, 1, 2]]  # one noise cell stays with the only island
    assert [sorted(b) for b in split([0, 5, 100, 105, 300])] == [[0, 1], [2, 3]]  # and is lost among two
    assert [sorted(b) for b in split([0, 100])] == [[0, 1]]
    assert len(split([0, 100], compat=True)) >= 2


def test_columns_of_a_table_stay_apart():
    x, y = np.array([0.0, 30, 60, 0, 30, 60, 0, 30]), np.array([0.0, 0, 0, 10, 10, 10, 100, 100])
    columns = [("t", 0), ("t", 1), None] * 2 + [None] * 2
    split = lambda **k: sorted(sorted(b) for b in kernels.split_iteratively(x, y, **k))
    assert split() == [[0, 1, 2, 3, 4, 5], [6, 7]]
    assert split(columns=columns) == [[0, 3], [1, 2, 4, 5], [6, 7]]  # the cell outside the table joins the nearer column
    assert split(columns=columns, compat=True) == split()
    assert split(columns=[("t", 0), ("u", 1), None] * 2 + [None] * 2) == split()
    assert split(columns=[None] * 8) == split()


def test_greedy_match_does_not_give_back():
    assert kernels.greedy_match([(0, 0, 0.5), (1, 0, 0.9), (1, 1, 0.6), (2, 1, 0.6)]) == [(0, 0, 0.5), (1, 1, 0.6)]
    assert kernels.greedy_match([(0, 1, 0.7), (0, 0, 0.7)]) == [(0, 0, 0.7)]


def test_clip_stack():
    ops = [("Tj", "a"), ("q", None), ("W", None), ("Tj", "b"), ("Q", None), ("TJ", "c"), ("W*", None), ("Q", None), ("'", "d")]
    assert kernels.walk_clip(ops) == [("a", False), ("b", True), ("c", False), ("d", False)]


def test_forms_inherit_the_clip():
    forms = {"f": [("Tj", "in"), ("W", None), ("Tj", "cut"), ("Do", "g")], "g": [("Tj", "deep"), ("Do", "f")]}
    assert kernels.walk_clip([("q", None), ("W", None), ("Do", "f"), ("Q", None), ("Do", "f"), ("Tj", "out"), ("Do", "none")], forms) == [("in", True), ("cut", True), ("deep", True), ("in", False), ("cut", True), ("deep", True), ("out", False)]


def test_containment_chain():
    boxes = np.array([[0, 0, 10, 10], [1, 1, 9, 9], [2, 2, 8, 8], [0, 0, 10, 10]], float)
    areas = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    assert kernels.consolidate_exact(areas, boxes, ["ABC", "b", "bc", "abc"]).tolist() == [True, False, False, False]
    assert kernels.consolidate_exact(areas, boxes, ["a", "b", "B", "c"]).tolist() == [True, True, False, True]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=20))))
def test_components(case):
    n, edges = case
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert kernels.find_components(n, edges).tolist() == label


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 100), st.floats(0, 20)), max_size=10))
def test_span_union(spans):
    spans = [(a, a + b) for a, b in spans]
    merged = kernels.merge_spans(spans)
    assert all(p[1] < q[0] for p, q in zip(merged, merged[1:], strict=False))
    assert all(any(m[0] <= a and b <= m[1] for m in merged) for a, b in spans)


def test_estimators():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (60, 3)), rng.normal(9, 1, (60, 3)), [[40, 40, 40]]])
    labels, k, score = outliers.best_kmeans(x[:120])
    assert k == 2 and score > 0.7 and len(set(labels[:60])) == 1
    assert outliers.isolation_scores(x).argmax() == 120
    assert outliers.vote(x)["is_anomaly"][120]
    assert outliers.hopkins(x[:120]) > 0.6
    y, _ = outliers.yeo_johnson(np.exp(rng.normal(0, 1, (300, 1))))
    skew = ((y - y.mean()) ** 3).mean() / y.std() ** 3
    assert abs(skew) < 0.3
    assert set(outliers.dbscan_2d(np.array([[0.0, 0], [1, 0], [2, 0], [99, 0]]), 1.5, 2).tolist()) == {0, -1}
    assert outliers.vote(x[:1])["votes"].tolist() == [0]


def test_rasters():
    r = np.zeros((16, 16))
    r[:, 8:] = 200
    fg, bg, ratio = appearance.two_colors(r)
    assert (fg.tolist(), bg.tolist(), ratio) == ([0] * 3, [200] * 3, 1.0)
    mask = appearance.foreground_mask(r, fg, bg)
    assert mask[:, :8].all() and not mask[:, 8:].any()
    g = appearance.gradient_statistics(r)
    assert g["max"] == 800 and g["min"] == 0 and g["lv_max"] > 0 and g["high_freq"] == 32 * 800 and g["high_to_low_ratio"] == float("inf")
    assert appearance.gradient_statistics(r, np.zeros((16, 16), bool))["mean"] == 0
    assert appearance.zero_crossings(np.array([[1, -1], [1, 1]])) == 2
    f = appearance.describe(np.stack([r, r / 2, r * 0], axis=2))
    assert f["bg_decimal"] == 200 * 65536 + 100 * 256 and f["high_to_low"] <= appearance.RATIO_CAP and set(f) == set(appearance.FEATURES)


def test_bilateral_keeps_edges_and_smooths_noise():
    rng = np.random.default_rng(4)
    r = np.where(np.arange(20) < 10, 0.0, 250.0)[None, :].repeat(20, axis=0)
    noisy = r + rng.normal(0, 5, r.shape)
    smooth = appearance.bilateral(noisy)
    assert np.abs(smooth - r)[:, :8].mean() < np.abs(noisy - r)[:, :8].mean() and smooth[:, 11:].mean() - smooth[:, :9].mean() > 200


def test_crop_takes_the_box_from_either_origin():
    page = np.arange(100 * 50).reshape(100, 50)
    assert (appearance.crop(page, (10, 20, 30, 40), 100, 72) == page[60:80, 10:30]).all()
    assert (appearance.crop(page, (10, 20, 30, 40), 100, 72, bottom_left=False) == page[20:40, 10:30]).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=40))
def test_dbscan_of_points(points):
    x = np.array(points, float).reshape(-1, 2)
    d = outliers.pairwise(x) if len(x) else np.zeros((0, 0))
    assert outliers.dbscan_2d(x).tolist() == outliers.density_labels(d, 12.0, 3).tolist()


def test_cluster_analysis_chain():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (60, 4)), rng.normal(12, 1, (60, 4)), [[60, -60, 60, 99]]])
    r = outliers.cluster_analysis(x)
    assert r["k"] >= 2 and r["is_anomaly"][120] and len(set(r["kmeans"][:60])) == 1 and r["hopkins"] > 0.5
    one = outliers.cluster_analysis(x[:1])
    assert one["hopkins"] == 0.5 and one["k"] == 1 and one["dbscan"].tolist() == [-1] and not one["is_anomaly"].any()


def test_dbscan_of_many_pages_is_that_of_each(monkeypatch):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 90, (n, 2)) * [3.0, 4.0] for n in (1, 2, 5, 40, 80, 120)]
    group = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    begins = np.searchsorted(group, np.arange(len(pages)))
    want = [np.where(x >= 0, x + b, -1) for x, b in zip((outliers.density_labels(np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)), 12.0, 3) for p in pages), begins, strict=True)]
    for most in (1 << 18, 50):
        monkeypatch.setattr(outliers, "_AT_ONCE", most)
        assert outliers.dbscan_2d(np.concatenate(pages), group=group).tolist() == np.concatenate(want).tolist()
    assert outliers.dbscan_2d(np.zeros((0, 2))).tolist() == []


def test_yeo_johnson_searches_all_features_together():
    """A feature's power doesn't hang on the others; constant and negative features are among them. Its calls follow the rounds, not the features."""
    rng = np.random.default_rng(5)
    x = np.stack([rng.exponential(size=40), rng.normal(size=40), np.full(40, 3.0), -rng.exponential(size=40)] * 8, axis=1)
    y, powers = outliers.yeo_johnson(x)
    for i in range(4):
        alone, p = outliers.yeo_johnson(x[:, i : i + 1])
        assert p[0] == powers[i] == powers[i + 4] and np.array_equal(alone[:, 0], y[:, i])
    assert powers[2] == 1.0
    calls = []
    profiler = lambda frame, event, arg: calls.append(1) if event == "call" and frame.f_code.co_name == "likelihood" else None
    sys.setprofile(profiler)
    try:
        outliers.yeo_johnson(x)
    finally:
        sys.setprofile(None)
    assert len(calls) < 100
