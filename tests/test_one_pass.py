"""Queries whose work is on one page read their table once."""

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as e
from folioscan.operators import kernels, pages, spatial


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("name", ["annotation_reasons", "severity_histogram"])
def test_reasons_read_boxes_once(spark, name):
    assert scans(e.queries()[name](spark, "/root/testdata/sf0.001")) == 1


def test_consolidated_pages_are_those_of_the_kernel(monkeypatch):
    """Many pages at once, boxes with unknown or crossed sides among them, and no more work than boxes that lie near each other."""
    rng = np.random.default_rng(3)
    page = np.sort(rng.integers(0, 30, 1500))
    boxes = np.round(rng.uniform(0, 60, (1500, 4)))
    boxes[:, 2:] = np.where(rng.random((1500, 1)) < 0.9, boxes[:, :2] + rng.integers(0, 30, (1500, 2)), boxes[:, 2:])
    boxes[rng.integers(0, 1500, 20), rng.integers(0, 4, 20)] = np.nan
    boxes[7] = (0, 0, np.inf, np.inf)
    texts = [("a", "A", "ab", "B")[k] for k in rng.integers(0, 4, 1500)]
    want = np.concatenate([kernels.consolidate_exact((boxes[m, 2] - boxes[m, 0]) * (boxes[m, 3] - boxes[m, 1]), boxes[m], [texts[i] for i in np.flatnonzero(m)]) for m in (page == k for k in np.unique(page))])
    assert 0 < want.sum() < 1500
    monkeypatch.setattr(pages, "_AT_ONCE", 50)
    assert np.array_equal(pages.consolidated(page, boxes, pa.array(texts)), want)


def test_best_match_goes_many_pages_at_a_time(spark):
    """One kernel over packed pages, no join; a page without a key meets none, of equal items the first is taken."""
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, "a"), (1, 2, 50.0, 0.0, 60.0, 10.0, "b"), (2, 1, 0.0, 0.0, 10.0, 10.0, "c"), (None, 1, 0.0, 0.0, 10.0, 10.0, "d"), (3, 1, None, 0.0, 10.0, 10.0, "e")], "page_ix long, box_id long, x0 double, y0 double, x1 double, y1 double, text string")
    s = spark.createDataFrame([(p, k, x, 0.0, x + 10.0, 10.0) for p, k, x in ((1, 9, 1.0), (1, 4, -1.0), (1, 5, 55.0), (2, 7, 0.0), (None, 3, 0.0), (3, 1, 0.0))], "page_ix long, item_id long, sx0 double, sy0 double, sx1 double, sy1 double")
    got = spatial.best_match(b, s)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.page_ix, r.text, r.item_id, r.match_iou) for r in got.collect()} == {(1, "a", 4, 90 / 110), (1, "b", None, None), (2, "c", 7, 1.0), (None, "d", None, None), (3, "e", None, None)}
