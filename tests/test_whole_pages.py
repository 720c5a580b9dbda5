"""Kernels over the sorted rows of whole pages."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from folioscan.operators import baselines, elements, kernels, matching, pages, spatial

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_kernels_see_whole_pages(spark, monkeypatch):
    """Pages over batches, larger than what a kernel gets, without a key: each comes once."""
    monkeypatch.setattr(kernels, "_ROWS", 10)
    rng = np.random.default_rng(1)
    rows = [(None if k == 7 else int(k), "ab"[k % 2]) for k in rng.integers(0, 40, 300)] + [(50, "a")] * 200

    def kernel(page, batch):
        first = pa.array(np.flatnonzero(np.diff(page, prepend=-1)))
        return pa.RecordBatch.from_arrays([batch.column("page").take(first), batch.column("part").take(first), pa.array(np.bincount(page))], ["page", "part", "n"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = kernels.whole_pages(spark.createDataFrame(rows, "page long, part string"), ["page", "part"], kernel, "page long, part string, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=repr) == sorted(((*k, n) for k, n in Counter(rows).items()), key=repr)


def test_samples_are_the_first_cells_of_an_edge(spark):
    """Against a plain reading, with unknown sides: an edge that isn't known is one of its own, a cell without a place comes first."""
    rng = np.random.default_rng(2)
    sides = lambda: tuple(None if rng.random() < 0.05 else float(x) for x in rng.integers(0, 8, 4) * 0.5)
    rows = [(int(rng.integers(0, 5)), f"c{i}", *sides()) for i in range(300)]
    b = spark.createDataFrame(rows, "page_ix long, box_id string, x0 double, y0 double, x1 double, y1 double")
    want = defaultdict(list)
    for page, ident, x0, y0, x1, y1 in rows:
        for side, edge, span in (("left", x0, (y0, y1)), ("right", x1, (y0, y1)), ("top", y0, (x0, x1)), ("bottom", y1, (x0, x1))):
            known = [s for s in span if s is not None]
            want[page, side, None if edge is None else float(round(edge))].append((min(known) if known else -1, max(known) if known else -1, ident))
    want = {k: (len(x), [i for _, _, i in sorted(x, key=lambda r: (r[0], r[2]))][:3], sum(b - a for a, b in kernels.merge_spans([r[:2] for r in x if r[0] >= 0]))) for k, x in want.items()}
    want = {k: x for k, x in want.items() if x[0] >= (3 if k[1] in ("left", "right") else 2)}
    got = {(r.page_ix, r.side, r.bucket): (r["count"], r.samples, r.coverage) for r in baselines.clusters(b, ["page_ix"], width=100.0, height=100.0, ident="box_id", keep=3).collect()}
    assert got == {k: (n, ids, round(length / 100 + 1e-9, 3)) for k, (n, ids, length) in want.items()} and any(k[2] is None for k in got)


@pytest.mark.parametrize("name, shuffles", [("baseline_samples", 1), ("refined_baselines", 2), ("baseline_chain_merge", 1), ("text_clusters", 1), ("typical_spacing", 1)])
def test_pages_need_one_shuffle_of_boxes(spark, name, shuffles):
    assert exchanges(e.queries()[name](spark, SF)) == shuffles


def test_clusters_are_those_of_all_pairs(spark):
    """Against all pairs of a page, boxes with unknown sides and idents that are texts among them."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        x, y = (float(v) for v in rng.integers(0, 60, 2))
        sides = [x, y, x + float(rng.integers(0, 14)), y + float(rng.integers(2, 6))]
        if rng.random() < 0.05:
            sides[rng.integers(0, 4)] = None
        rows.append((int(rng.integers(0, 6)), f"b{rng.integers(0, 10**6)}-{i}", *sides))
    b = spark.createDataFrame(rows, "page_ix long, box_id string, x0 double, y0 double, x1 double, y1 double")
    want, spaced = {}, {}
    for page in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == page]
        known = [r for r in mine if None not in r]
        w, h = (float(np.median([1e-12 if None in (r[k], r[k + 2]) else max(1e-12, r[k + 2] - r[k]) for r in mine])) for k in (1, 2))
        mx, my = (min(r[k] for r in mine if r[k] is not None) for k in (1, 2))
        cell = {r[0]: [int((v - m) // s) for v, m, s in zip(r[1:], (mx, my, mx, my), (w, h, w, h), strict=True)] for r in known}
        gaps = {}
        for p in known:
            for q in known:
                c, e_ = cell[p[0]], cell[q[0]]
                shared, narrow = min(p[3], q[3]) - max(p[1], q[1]), min(p[3] - p[1], q[3] - q[1])
                if p != q and all(e_[k] <= c[k + 2] + 1 and e_[k + 2] >= c[k] - 1 for k in (0, 1)) and narrow > 0 and shared >= 0.15 * narrow:
                    gaps[p[0], q[0]] = max(0.0, q[2] - p[4], p[2] - q[4])
        least = [min(v) for v in ([g for (a, _), g in gaps.items() if a == r[0] and g > 0] for r in known) if v]
        spaced[page] = (float(np.median(least)), len(least))
        up = {r[0]: r[0] for r in mine}
        for _ in mine:
            for (a, c), g in gaps.items():
                if g <= 1.25 * spaced[page][0]:
                    up[a] = up[c] = min(up[a], up[c])
        want |= {(page, k): x for k, x in up.items()}
    got = {(r.page_ix, r.box_id): r.component for r in spatial.clusters(b).collect()}
    assert got == want and 20 < len(set(want.values())) < 220
    assert {r.page_ix: (r.spacing, r.n) for r in spatial.typical_spacing(b).collect()} == spaced


def test_far_bins_and_pages_stay_apart():
    """Bins whose numbers outgrow 64 bits; pages don't meet."""
    far = 1e15
    a = np.array([[0.0, 0, 9, 9], [far, far, far + 9, far + 9], [0, 0, 9, 9]])
    i, j = pages.meeting(a, a, pages=(np.array([0, 0, 1]), np.array([0, 0, 1])))
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (1, 1), (2, 2)]


def test_hidden_boxes_are_those_of_single_pages(spark, monkeypatch):
    """Pages in small shares, without a key among them, give what each gives alone."""
    monkeypatch.setattr(kernels, "_ROWS", 20)
    rng = np.random.default_rng(6)
    rows = [(None if k == 5 else int(k), i, *(float(v) for v in (x, y, x + 30, y + 10)), "ab"[int(t)] * 4) for i, (k, x, y, t) in enumerate(zip(rng.integers(0, 6, 200), rng.integers(0, 100, 200), rng.integers(0, 60, 200), rng.integers(0, 2, 200), strict=True))]
    b = spark.createDataFrame(rows, "page_ix long, box_id long, x0 double, y0 double, x1 double, y1 double, text string")
    found = lambda df: {tuple(r) for r in matching.hidden_text(df, df.filter("box_id % 3 = 0"), "word", ("page_ix",), "box_id").collect()}
    want = set()
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        near = lambda p, q: k is not None and p[6] == q[6] and p[2] < q[4] and q[2] < p[4] and max(0, q[3] - p[5], p[3] - q[5]) <= 5
        seen = [r for r in mine if any(near(r, o) for o in mine if o[1] % 3 == 0)]
        for r in set(mine) - set(seen):
            shared = [max(0, min(r[4], o[4]) - max(r[2], o[2])) * max(0, min(r[5], o[5]) - max(r[3], o[3])) for o in seen]
            want.add((k, r[1], r[6], "overlap" if any(s / (600 - s) >= 0.1 for s in shared) else "missing"))
    assert found(b) == want and {r[3] for r in want} == {"overlap", "missing"}


def test_names_meet_by_few_stretches(spark):
    """A name has only stretches as long as some held name's last characters, not of every length up to eight."""
    one = spark.createDataFrame([("ABCDEF+Supplier#000000012", [8]), ("abab", [0, 2, 8])], "font string, lengths array<int>").select(F.sort_array(elements._parts(F.col("font"), F.col("lengths"))).alias("p"))
    (long,), (short,) = one.collect()
    assert len(long) == 18 and set(map(len, long)) == {8} and short == ["", "ab", "ba"]
