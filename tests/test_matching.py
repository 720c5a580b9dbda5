"""One-to-one matching of cells and spans, by page and by rounds, with what is left on both sides."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from folioscan.operators import kernels, matching, pages, spatial
from folioscan.plans import q_text, views
from folioscan.sources import payload

SCHEMA = "doc_id long, page_ix long, cell long, span long, score double"


def test_rounds_equal_the_order_of_cells(spark):
    rng = random.Random(7)
    rows = [(p % 5, p, c, s, rng.choice([0.5, 0.6, 0.7, rng.random()])) for p in range(30) for c in range(rng.randint(1, 14)) for s in rng.sample(range(12), rng.randint(0, 8))]
    rows += [(9, 99, c, s, 1.0 - s / 40) for c in range(25) for s in range(25)]  # every cell wants the same spans in the same order
    found = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {(d, p, *m) for d, p in {r[:2] for r in rows} for m in kernels.greedy_match([r[2:] for r in rows if r[:2] == (d, p)])}
    assert {tuple(r) for r in matching.by_rounds(found).collect()} == want
    for most in (0, 20, 10**9):
        assert {tuple(r) for r in matching.greedy(found, most=most).collect()} == want


def test_a_page_of_very_many_cells_is_many_tasks(spark):
    n = 100_000
    ids = spark.range(n, numPartitions=16)
    found = ids.select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("page_ix"), F.col("id").alias("cell"), F.explode(F.array(F.col("id"), F.col("id") + 1 - 2 * (F.col("id") % 2))).alias("span"))
    found = found.withColumn("score", F.when(F.col("span") % 2 == 0, 0.9).otherwise(0.8))  # pairs of cells want the same span
    got = matching.greedy(found)
    assert got.count() == n and got.filter("cell <> span").count() == 0


def test_payloads_are_matched_with_leftovers(spark, tmp_path):
    rect = lambda x0, y0, x1, y1: {"r_x0": x0, "r_y0": y1, "r_x1": x1, "r_y1": y1, "r_x2": x1, "r_y2": y0, "r_x3": x0, "r_y3": y0}
    cells = [{"text": t, "rect": rect(*b)} for t, b in (("Total due", (10, 10, 60, 20)), ("Total due", (10, 10, 60, 20)), ("lonely", (300, 300, 340, 310)), (" ", (0, 0, 5, 5)))]
    spans = [{"text": t, "bbox": b, "font": "F", "size": 9, "color": 0} for t, b in (("total due ", [10, 10, 60, 20]), ("Total du", [10, 10, 60, 20]), ("unseen", [500, 500, 540, 510]), (" ", [0, 0, 1, 1]))]
    (tmp_path / "cells").mkdir()
    (tmp_path / "spans").mkdir()
    (tmp_path / "cells" / "a.json").write_text(json.dumps({"parsed_pages": {"0": {"page_no": 0, "size": {"width": 612, "height": 792}, "cells": cells}}}))
    (tmp_path / "spans" / "a.json").write_text(json.dumps({"pages": [{"page_no": 1, "blocks": [{"type": 0, "lines": [{"spans": spans[:1]}, {"spans": spans[1:]}, {}]}, {"type": 1}, {"type": 0}]}]}))
    got = matching.match_payloads(payload.read(spark, str(tmp_path / "cells")), payload.read(spark, str(tmp_path / "spans"), payload.SPAN_PAYLOAD))
    rows = {(r.cell, r.span, r.side, r.match_method) for r in got.collect()}
    assert rows == {(0, 0, "matched", "text_based"), (1, 1, "matched", "text_based"), (2, None, "cell", None), (None, 2, "span", None)}
    s = matching.outcome_statistics(got).first()
    assert (s.total_cells, s.total_spans, s.matched, s.unmatched_cells, s.unmatched_spans, s.text_based) == (3, 3, 2, 1, 1, 2)
    assert abs(s.cell_match_rate - 200 / 3) < 1e-9 and s.cell_match_rate == s.span_match_rate


def test_boxes_meet_as_in_a_comparison_of_all(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(pages, "_AT_ONCE", 500)
    for size in (5, 60, 900):
        low = rng.integers(-200, 600, (2, 80, 2)).astype(float)
        a, b = np.concatenate([low, low + rng.integers(0, size, (2, 80, 2))], axis=2)
        a[3] = np.nan
        want = [(i, j) for i in range(80) for j in range(80) if (a[i, :2] < b[j, 2:]).all() and (b[j, :2] < a[i, 2:]).all()]
        for bins in (spatial.BINS, (30.0, 500.0), None):
            assert list(zip(*(x.tolist() for x in pages.meeting(a, b, bins)), strict=True)) == want


def test_renderings_meet_in_one_shuffle(spark):
    d = "/root/testdata/sf0.001"
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(views.cells(spark, d)) == 0
    assert [exchanges(q(spark, d)) for q in (q_text.closest_visible, q_text.visible_semi_join, q_text.match_candidates, q_text.not_visible_anti_join)] == [1, 1, 1, 1]
    assert exchanges(q_text.hidden_text(spark, d)) == 2


def test_pages_without_a_number_meet_none(spark):
    rows = [(1, None, 1, "word", 0.0, 0.0, 9.0, 9.0), (1, 0, 1, "word", 0.0, 0.0, 9.0, 9.0), (1, 0, 2, " ", 0.0, 0.0, 9.0, 9.0), (1, 0, 3, "other", None, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_ix long, cell_index long, text string, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in matching.find_visible(df, df, "word").collect()] == [(1, 0, 1, 1, "primary_iou")]
    assert {tuple(r) for r in matching.unseen(df, df, "word").collect()} == {(1, None, 1, "word"), (1, 0, 3, "other")}
    assert {tuple(r) for r in matching.hidden_text(df, df, "word").collect()} == {(1, None, 1, "word", "missing"), (1, 0, 3, "other", "missing")}
