"""Annotations from the detectors' own rows, and layout blocks of structured files."""

import json

from pyspark.sql import functions as F

from folioscan.operators import alignment, annotations, colons, matching, profile
from folioscan.sources import payload


def test_reasons_of_all_detectors_meet(spark):
    cells = [(1, 0, i, f"c{i}", 40.0, 14.0 * i, 90.0, 14.0 * i + 10) for i in range(20)] + [(1, 0, 20, "c20", 52.0, 280.0, 102.0, 290.0)]
    df = spark.createDataFrame(cells, "doc_id long, page_ix long, cell_index long, text string, x0 double, y0 double, x1 double, y1 double")
    blocked = df.withColumn("block_id", F.lit(0))
    keys = ["doc_id", "page_ix"]
    off = alignment.column_anomalies(blocked, alignment.block_alignment(blocked, keys, "cell_index"), keys, "cell_index")
    hidden = matching.hidden_text(df, df.filter("cell_index <> 20"))
    named = df.withColumn("font_name", F.when(F.col("cell_index") == 20, "Odd").otherwise("F"))
    rare = profile.rare(profile.profile(named, profile.CELLS, order=("cell_index",), item=("text", "x0", "y0", "x1", "y1")))
    pairs = df.select(*keys, "cell_index", F.lit("l").alias("label"), F.col("text").alias("value"), F.when(F.col("cell_index") == 20, 30.0).otherwise(4.0).alias("spacing"), F.col("x0").alias("value_x0"), (F.col("x1") + F.col("cell_index") * 9).alias("value_x1"), F.lit(False).alias("same_cell"), F.lit(None).cast("double").alias("cell_x0"), "y0", "y1")
    found = colons.findings(pairs, keys)
    odd = df.withColumn("votes", F.when(F.col("cell_index") == 20, 3).otherwise(1))
    run = spark.createDataFrame([(1, 0, 50.0, "c20", 52.0, 102.0, "LOW")], "doc_id long, page_ix long, line double, text string, x0 double, x1 double, severity string")
    got = annotations.gather(annotations.across(run), annotations.off_both_sides(off, df), annotations.off_column(off, df), annotations.hidden(hidden, df), annotations.rare(rare), annotations.outliers(odd), annotations.colon(found)).collect()
    by_box = {(r.text, r.x1): r.reasons for r in got}
    by_box["c20", 102.0] = [r for x in got if (x.text, x.x1, x.y0) == ("c20", 102.0, 280.0) for r in x.reasons]
    assert [x.reasons for x in got if x.y0 == 50.0] == [["a baseline passes through (LOW)"]]
    assert by_box["c20", 102.0] == ["a number on no edge of either side", "hidden text: missing", "odd appearance (3 of 3 methods)", "off the right edge by 12.0 (HIGH)", "rare font_name: Odd"]
    assert by_box["c20", 282.0] == ["label and value: off by 26.0 (spacing 30.0, usual 4.0): plain text"] and len(by_box) == 2


def test_columns_and_paragraphs_are_blocks(spark, tmp_path):
    box = lambda *b: dict(zip("ltrb", b, strict=True))
    grid = [[{"text": "a", "bbox": box(0, 0, 10, 5)}, {"text": "b", "bbox": box(20, 0, 30, 5)}], [{"text": "c", "bbox": box(0, 10, 12, 15)}, {"text": "d"}, {"text": "beyond", "bbox": box(90, 0, 99, 5)}]]
    body = {
        "parsed_pages": {"0": {"page_no": 0, "size": {"width": 612, "height": 792}, "cells": []}},
        "docling_document": {
            "tables": [{"prov": [{}, {"page_no": 1}], "data": {"grid": grid}}, {"prov": [], "data": {"grid": grid}}],
            "texts": [{"label": "text", "text": "x" * 60, "prov": [{"page_no": 1, "bbox": {**box(1, 700, 9, 690), "coord_origin": "BOTTOMLEFT"}}]}, {"label": "text", "text": "no box", "prov": [{"page_no": 1}]}, {"label": "text", "text": "no page", "prov": []}],
        },
    }
    (tmp_path / "a.json").write_text(json.dumps(body))
    got = {(r.page_ix, r.kind, r.column_ix, r.x0, r.y0, r.x1, r.y1, r.text) for r in payload.structure_blocks(payload.read(spark, str(tmp_path))).collect()}
    assert got == {(0, "table_column", 0, 0, 0, 12, 15, ""), (0, "table_column", 1, 20, 0, 30, 5, ""), (0, "paragraph", None, 1, 92, 9, 102, "x" * 50)}
