"""Lookups along one axis on the cells of a payload, against plain readings."""

import json
import random

from pyspark.sql import functions as F

from folioscan.operators import lookups
from folioscan.sources import payload

KEYS = ["doc_id", "page_ix"]


def test_lookups_on_payload_cells(spark, tmp_path):
    rng = random.Random(9)
    for d in range(2):
        pages = {}
        for p in range(2):
            cells = [{"text": f"t{i}", "rect": {"x0": x, "y0": y, "x1": x + rng.choice([20, 31, 60]), "y1": y + 10}} for i in range(40) for x, y in [(rng.choice([40, 41.2, 100, 133, 260]), rng.choice([10, 11.5, 30, 55, 57.9, 90]))]]
            pages[str(p)] = {"page_no": p, "size": {"width": 612, "height": 792}, "cells": cells}
        (tmp_path / f"d{d}.json").write_text(json.dumps({"parsed_pages": pages}))
    cells = payload.cells(payload.read(spark, str(tmp_path))).select("doc_id", "page_ix", F.col("cell_index").alias("box_id"), "x0", "y0", "x1", "y1").cache()
    rows = {}
    for r in cells.collect():
        rows.setdefault((r.doc_id, r.page_ix), []).append(r)
    lines = spark.createDataFrame([(d, p, v, n) for d, p in rows for v, n in ((39.0, 5), (102.0, 2), (98.0, 9), (262.0, 1))], "doc_id string, page_ix int, value double, n int")
    seen = lambda df, *c: {(r.doc_id, r.page_ix, r.box_id): tuple(r[x] for x in c) for r in df.collect()}
    value = seen(lookups.value_of_label(cells, KEYS), "value")
    near = seen(lookups.nearest_within(cells, lines, KEYS, F.col("x0"), 3.0).select(*KEYS, "box_id", F.col("near.label").alias("v")), "v")
    first = seen(lookups.first_within(cells, lines, KEYS, F.col("x0"), 3.0, [-F.col("n")]), "first")
    below = seen(lookups.next_baseline(cells, lines, KEYS, F.col("x1")), "next")
    shared = seen(lookups.shared_right_edges(cells, KEYS), "n")
    island = seen(lookups.islands(cells, KEYS, "x0", 30.0), "island")
    for page, cs in rows.items():
        at = [39.0, 102.0, 98.0, 262.0]
        order = [98.0, 39.0, 102.0, 262.0]
        split, k = {}, 0
        for a, b in zip([None, *sorted({c.x0 for c in cs})], sorted({c.x0 for c in cs}), strict=False):
            k += a is None or b - a > 30
            split[b] = k
        edge = lambda c: round(c.x1 * 0.67) / 0.67
        for c in cs:
            key = (*page, c.box_id)
            assert value[key][0] == min((o.box_id for o in cs if o.box_id > c.box_id and abs(o.y0 - c.y0) <= 3 and o.x0 > c.x0 and o.x0 - c.x1 <= 75), default=None)
            assert near[key][0] == min(((abs(c.x0 - v), v) for v in at if abs(c.x0 - v) <= 3), default=(0, None))[1]
            assert first[key][0] == next((v for v in order if abs(c.x0 - v) <= 3), None)
            assert below[key][0] == min((v for v in at if v >= c.x1), default=None)
            same = sum(edge(o) == edge(c) for o in cs)
            assert shared.get(key, (None,))[0] == (same if same >= 2 else None) and island[key][0] == split[c.x0]
    spacing = lookups.modal_spacing(cells, KEYS).collect()
    assert len(spacing) == 4 and all(r.n >= 1 and r.mean > 0 for r in spacing)
