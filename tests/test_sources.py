import json

from pyspark.sql import functions as F

from folioscan.operators import alignment, appearance, elements, matching, pairs, report
from folioscan.sources import payload
from folioscan.streaming import ingest

RECT = {f"r_{c}{i}": v for i, (x, y) in enumerate(((10, 20), (60, 20), (60, 30), (10, 30))) for c, v in (("x", x), ("y", y))}
PAYLOAD = {
    "metadata": {"num_pages": 1, "total_cells": 4, "has_parsed_pages": True},
    "docling_document": {
        "tables": [{"prov": [{"page_no": 1, "bbox": {"l": 0, "t": 0, "r": 9, "b": 9}}], "data": {"num_rows": 1, "num_cols": 2, "grid": [[
            {"text": "h", "bbox": {"l": 0, "t": 0, "r": 5, "b": 4}, "start_row_offset_idx": 0, "start_col_offset_idx": 0, "column_header": True},
            {"text": "v", "bbox": {"l": 5, "t": 6, "r": 9, "b": 2}, "start_row_offset_idx": 0, "start_col_offset_idx": 1}]]}}],
        "texts": [{"label": "section_header", "text": "T", "prov": [{"page_no": 1, "bbox": {"l": 1, "t": 700, "r": 9, "b": 690, "coord_origin": "BOTTOMLEFT"}}]}],
    },
    "parsed_pages": {"0": {"page_no": 0, "cells": [{"text": "Total: 5", "rect": RECT, "index": 0}, {"text": " ", "rect": RECT}, {"text": "no box"}, {"text": "simple", "rect": {"x0": 9, "y0": 1, "x1": 3, "y1": 2}}]}},
}


def _write(folder, name, body):
    (folder / name).write_text(body if isinstance(body, str) else json.dumps(body))


def test_payloads(spark, tmp_path):
    _write(tmp_path, "doc a.json", PAYLOAD)
    _write(tmp_path, "bad.json", "{ not json")
    p = payload.read(spark, str(tmp_path))
    assert {r.doc_id: r._error for r in p.select("doc_id", "_error").collect()} == {"doc a": None, "bad": "malformed"}
    cells = payload.cells(p).orderBy("cell_index").collect()
    assert [(c.text, c.cell_index, c.x0, c.y0, c.x1, c.y1, c.width, c.font_name) for c in cells] == [("Total: 5", 0, 10, 20, 60, 30, 612, "Unknown"), ("simple", 3, 3, 1, 9, 2, 612, "Unknown")]
    assert [(t.table_id, t.page_ix, t.tx0, t.ty0, t.tx1, t.ty1, t.cells) for t in payload.tables(p).collect()] == [(0, 0, 0, 0, 9, 6, 2)]
    items = {(s.kind, s.sy0, s.sy1) for s in payload.structure(p).collect()}
    assert items == {("section_header", 92, 102), ("column_header", 0, 4), ("body", 2, 6)}
    assert [r.name for r in payload.latest(spark.createDataFrame([("x_20240101_000000",), ("x_20240301_000000",), ("y",)], "doc_id string")).orderBy("name").collect()] == ["x", "y"]


def test_spans_ocr_and_elements(spark, tmp_path):
    _write(tmp_path, "s.json", {"pages": [{"page_no": 1, "blocks": [{"type": 0, "lines": [{"spans": [{"text": "t", "bbox": [1, 2, 3, 4], "font": "AB+Times", "size": 9, "color": 0x102030, "flags": 0}]}]}, {"type": 1}]}]})
    s = payload.spans(payload.read(spark, str(tmp_path), payload.SPAN_PAYLOAD))
    assert [(r.page_ix, r.red, r.green, r.blue, r.x1) for r in s.collect()] == [(0, 16, 32, 48, 3)]
    fonts = spark.createDataFrame([("s", 1, "Times", True)], "doc_id string, font_id int, name string, embedded boolean")
    assert elements.font_of(s, fonts).first().font_name == "Times"
    ocr = tmp_path / "ocr"
    ocr.mkdir()
    _write(ocr, "o.json", {"pages": [{"page_number": 1, "lines": [{"content": "a b", "polygon": [1, 1, 2, 1, 2, 1.5, 1, 1.5], "words": [{"content": "a", "confidence": 0.5}, {"content": "b", "confidence": 1}]}, {"content": "c", "polygon": [0, 0, 1, 1], "words": []}]}]})
    got = payload.ocr_cells(payload.read(spark, str(ocr), payload.OCR_PAYLOAD)).orderBy("cell_index").collect()
    assert [(r.x0, r.y0, r.x1, r.y1, r.confidence) for r in got] == [(72, 72, 144, 108, 0.75), (0, 0, 72, 72, 0.0)]
    tree = spark.createDataFrame([("d", 1, None, 3), ("d", 2, 1, None), ("d", 3, 2, 5)], "doc_id string, id int, parent int, page int")
    assert {(r.id, r.page, r.depth) for r in payload.flatten_elements(tree).collect()} == {(1, 3, 0), (2, 3, 1), (3, 5, 2)}
    flags = spark.createDataFrame([(True, False, None, True)], "print boolean, copy boolean, modify boolean, annotate boolean")
    assert payload.permissions(flags).first().note == "not allowed: copy"
    cut = spark.createDataFrame([("d", 0, i) for i in range(2)] + [("d", 1, 0), ("e", 0, 0)], "doc_id string, page_ix int, span_index int")
    events = spark.createDataFrame([("d", 0, i, i == 2) for i in range(5)] + [("d", 1, 9, True)], "doc_id string, page_ix int, event_id int, has_clip boolean")
    assert {(r.doc_id, r.page_ix, r.span_index, r.has_clip) for r in elements.clip_of(cut, events).collect()} == {("d", 0, 0, False), ("d", 0, 1, True), ("d", 1, 0, True), ("e", 0, 0, False)}


def test_element_trees(spark):
    deep = spark.createDataFrame([("d", i, i - 1 if i else None, 7 if i == 0 else None) for i in range(300)] + [("d", 900, 901, 1), ("d", 901, 900, 1), ("d", 950, 999, 1)], "doc_id string, id int, parent int, page int")
    got = {r.id: (r.page, r.depth) for r in payload.flatten_elements(deep, most=1024).collect()}
    assert got == {i: (7, i) for i in range(300)}  # neither the cycle nor the orphan


def test_character_word_and_element_payloads(spark, tmp_path):
    at = {"x0": 1, "top": 2, "x1": 3, "bottom": 4}
    for name in ("chars", "words", "spans", "elements", "enhanced"):
        (tmp_path / name).mkdir()
    _write(tmp_path / "chars", "c.json", {"pages": [{"page_number": 1, "chars": [{"text": "a", "fontname": "F", "size": 9, **at}], "lines": [at], "rects": [at, at], "curves": [], "images": None, "words": [{"text": "w", **at}]}]})
    c = payload.read(spark, str(tmp_path / "chars"), payload.CHARS_PAYLOAD)
    assert [tuple(r)[1:] for r in payload.chars(c).collect()] == [(0, 0, "a", "F", 9, 1, 2, 3, 4)]
    assert sorted(r.kind for r in payload.shapes(c).collect()) == ["line", "rect", "rect"]
    assert [(r.text, r.font) for r in payload.words(c).collect()] == [("w", None)]
    _write(tmp_path / "words", "w.json", {"pages": [{"page_number": 2, "words": [{"text": "w", "fontname": "F", "size": 9, **at}], "tables": [{"table_index": 0, "data": [["a", None], ["b", "c"]]}]}]})
    w = payload.read(spark, str(tmp_path / "words"), payload.WORDS_PAYLOAD)
    assert [(r.page_ix, r.text, r.font, r.y1) for r in payload.words(w).collect()] == [(1, "w", "F", 4)]
    assert {(r.row, r.column, r.text) for r in payload.word_tables(w).collect()} == {(0, 0, "a"), (0, 1, None), (1, 0, "b"), (1, 1, "c")}
    _write(tmp_path / "spans", "s.json", {"pages": [{"page_number": 1, "width": 612, "height": 792, "rotation": 0, "text_blocks": [[1, 2, 3, 4, "x" * 60, 0, 0], ["?", 2, 3, 4, "y"]], "words": [[1, 2, 3, 4, "w", 0, 0, 0]], "images": [{"xref": 1}], "links": [], "drawings": [{"type": "f"}]}]})
    s = payload.read(spark, str(tmp_path / "spans"), payload.SPAN_PAGES)
    assert [(r.x1, r.text) for r in payload.layout_blocks(s).collect()] == [(3, "x" * 50)]
    assert [(r.text, r.y1) for r in payload.span_words(s).collect()] == [("w", 4)]
    assert [(r.images, r.links, r.drawings) for r in payload.page_objects(s).collect()] == [(1, 0, 1)]
    rows = [{"Path": "//Document/P[0]/StyleSpan", "Page": 0, "Text": "t", "BBox": {"x0": 5, "y0": 6, "x1": 1, "y1": 2}}, {"Path": "//Document/Figure[2]", "attributes": {"BBox": [1, 2, 3, 4]}, "Bounds": [9, 9, 9, 9]}, {"Path": "//Document/P", "BBox": "none", "Bounds": [1, 1, 2, 2]}, {"Path": "//Document/P"}]
    _write(tmp_path / "elements", "e.json", {"elements": rows})
    e = payload.read(spark, str(tmp_path / "elements"), payload.ELEMENTS_PAYLOAD)
    got = [(r.kind, r.bbox_source, r.x0, r.y0, r.x1, r.y1) for r in payload.elements(e).orderBy("element_index").collect()]
    assert got == [("StyleSpan", "BBox", 1, 2, 5, 6), ("Figure", "attributes.BBox", 1, 2, 3, 4), ("P", "Bounds", 1, 1, 2, 2), ("P", None, None, None, None, None)]
    assert {(r.kind, r.n) for r in payload.element_histogram(e).collect()} == {("StyleSpan", 1), ("Figure", 1), ("P", 2)}
    full = {"summary_stats": {"mean": 1.5}, "frequency_energy": {"high_freq": 2, "high_to_low_ratio": "Infinity"}, "laplacian": {"zero_crossings": 4}, "bilateral": {"edge_preservation": 0.5}}
    _write(tmp_path / "enhanced", "x.json", {"elements": [{"cell_data": {"text": "t"}, "pillow_analysis": {"foreground_color": [1, 2, 3], "text_to_background_ratio": 0.25}, "edge_gradient_analysis": {"full_bbox": full}}, {}]})
    f = payload.feature_rows(payload.read(spark, str(tmp_path / "enhanced"), payload.ENHANCED_PAYLOAD)).orderBy("id").collect()
    first = dict(zip(f[0].names, f[0].x, strict=True))
    assert (first["fg_decimal"], first["bg_decimal"], first["text_to_bg_ratio"], first["mean_grad"], first["high_to_low"], first["lap_zero_crossings"], first["bil_edge_pres"]) == (66051, 16777215, 0.25, 1.5, 1000, 4, 0.5)
    assert len(f[1].x) == 26 and f[1].x[:4] == [0, 0, 255, 16777215] and sum(f[1].x[4:]) == 0


def test_boxes_are_flipped_by_their_own_pages_height(spark, tmp_path):
    body = {"docling_document": {"tables": [{"prov": [{"page_no": 1}], "data": {"grid": [[{"text": "a", "bbox": {"l": 0, "t": 90, "r": 9, "b": 80, "coord_origin": "BOTTOMLEFT"}}]]}}], "texts": []}, "parsed_pages": {"0": {"page_no": 0, "size": {"width": 50, "height": 100}, "cells": [{"text": "c", "rect": {"l": 0, "t": 40, "r": 9, "b": 30, "coord_origin": "BOTTOMLEFT"}}]}}}
    _write(tmp_path, "d.json", body)
    p = payload.read(spark, str(tmp_path))
    assert [(r.y0, r.y1) for r in payload.table_cells(p).collect()] == [(10, 20)]
    assert [(r.y0, r.y1) for r in payload.table_cells(p, compat=True).collect()] == [(80, 90)]
    assert [(r.y0, r.y1) for r in payload.cells(p).collect()] == [(60, 70)]
    pages = spark.createDataFrame([("d", 0), ("d", 1)], "doc_id string, page_ix int")
    assert {(r.page_ix, r.has_text, r.preview) for r in payload.with_text(payload.cells(p), pages).collect()} == {(0, True, "c"), (1, False, "")}


def test_table_checks_labels_and_cluster_summaries(spark, tmp_path):
    from folioscan.functions import text as tx

    grid = [[{"text": " a "}, {"text": ""}, {"text": "c"}], [{"text": "d"}, {"text": "e"}, {"text": "f"}]]
    tables = [{"prov": [{"page_no": 2, "bbox": {"l": 1, "t": 50, "r": 11, "b": 20}}], "data": {"grid": grid}}, {"prov": [{"page_no": 1, "bbox": {"l": 0, "t": 1, "r": 2, "b": 4}}], "data": {"grid": []}}]
    _write(tmp_path, "d.json", {"docling_document": {"tables": tables, "texts": []}})
    got = payload.table_checks(payload.read(spark, str(tmp_path))).orderBy("table_id").collect()
    assert (got[0].page_ix, got[0].n_rows, got[0].n_columns, got[0].n_cells, got[0].samples) == (1, 2, 3, 6, ["[0,0]: a", "[0,2]: c", "[1,0]: d", "[1,1]: e", "[1,2]: f"])
    assert got[0].warning is not None and got[1].warning is None and (got[1].width, got[1].height, got[1].area) == (2, 3, 6)
    labels = spark.createDataFrame([("regular",), ("odd",)], "k string").select(tx.rounding_label(F.col("k")).alias("l")).collect()
    assert [r.l for r in labels] == [tx.ROUNDING_LABELS["regular"], "odd"]
    rows = spark.createDataFrame([(1, 0, 0.5, 2, 0.25, 1.0, 0, False), (1, 1, 0.5, 2, 0.25, 1.0, -1, True)], "doc long, id long, hopkins double, k long, silhouette double, eps double, dbscan long, is_anomaly boolean")
    s = report.cluster_summary(rows).first()
    assert (s.n_samples, s.kmeans_clusters, s.dbscan_clusters, s.noise, s.anomalies) == (2, 2, 1, 1, 1)


def test_enhanced_text_keeps_errors(spark):
    schema = "doc_id long, page_ix long, cell_index long, text string, x0 double, y0 double, x1 double, y1 double"
    cells = spark.createDataFrame([(1, 0, 0, "dark", 0.0, 0.0, 40.0, 10.0), (1, 0, 1, "bad", 50.0, 0.0, 80.0, 10.0), (1, 0, 2, "gone", 90.0, 0.0, 120.0, 10.0), (1, 0, 3, " ", 0.0, 20.0, 9.0, 30.0), (1, 0, 4, "other", 0.0, 50.0, 9.0, 60.0)], schema)
    pixels = [255.0] * 48 + [0.0] * 16
    rasters = spark.createDataFrame([(1, 0, 0, pixels, 8, 8), (1, 0, 1, pixels, 3, 3)], "doc_id long, page_ix long, cell_index long, pixels array<double>, height int, width int")
    got = {r.cell_index: r for r in appearance.enhanced_text(cells, cells.filter("cell_index <> 4"), rasters).collect()}
    assert sorted(got) == [0, 1, 2]
    assert got[0]._error is None and got[0].fg_luminance == 0 and got[0].bg_luminance == 255 and got[0].match_method == "text_based"
    assert "ValueError" in got[1]._error and got[2]._error == "no raster"


def test_stream_takes_each_file_once(spark, tmp_path):
    drop, out = tmp_path / "in", str(tmp_path / "out")
    drop.mkdir()
    for n in range(2):
        _write(drop, f"d{n}.json", PAYLOAD)
        ingest.ingest(spark, str(drop), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 4
    again = payload.cells(payload.read(spark, str(drop / "d1.json")))
    ingest.write_epoch(again, 1, out)  # a batch that is repeated takes its own place
    assert spark.read.parquet(out).count() == 4 and spark.read.parquet(out).select("_epoch").distinct().count() == 2


def test_listing_pending_and_first_match(spark, tmp_path):
    for name in ("b c.pdf", "a+1.pdf", "Z.pdf", "a.txt"):
        (tmp_path / name).write_bytes(b"x" * 3)
    listed = payload.listing(spark, str(tmp_path))
    assert {(r.doc_id, r.length) for r in listed.collect()} == {("b c", 3), ("a+1", 3), ("Z", 3)} and "content" not in listed.columns
    done = spark.createDataFrame([("Z", 1), ("Z", 2)], "doc_id string, n int")
    assert {r.doc_id for r in payload.pending(listed, done).collect()} == {"b c", "a+1"} and payload.pending(listed, done.limit(0)).count() == 3
    assert payload.first_match(listed, "C").first().doc_id == "b c" and payload.first_match(listed, "").first().doc_id == "Z" and payload.first_match(listed, "nothing").count() == 0


def test_hidden_text(spark):
    cell = lambda i, text, x0, x1: ("d", 0, i, text, float(x0), 0.0, float(x1), 10.0)
    schema = "doc_id string, page_ix int, cell_index int, text string, x0 double, y0 double, x1 double, y1 double"
    original = spark.createDataFrame([cell(0, "amount", 0, 40), cell(1, "9,999", 5, 38), cell(2, "gone", 100, 130), cell(3, "unknown", 200, 230)], schema)
    visible = spark.createDataFrame([cell(0, "Amount", 0, 40)], schema)
    found = {(r.cell_index, r.kind) for r in matching.hidden_text(original, visible, "word").collect()}
    assert found == {(1, "overlap"), (2, "missing")}
    assert matching.hidden_text(original, visible.limit(0)).count() == 3
    assert {r.mode for r in matching.segmentation(original, visible).collect()} == {"word"}


def test_pairs(spark):
    cell = lambda i, text, x0, x1, y=0.0: (0, i, text, float(x0), float(x1), y)
    cells = spark.createDataFrame([cell(0, "Name:", 0, 30), cell(1, "Ann", 40, 60), cell(2, "Lee", 65, 80), cell(3, "Tel:", 120, 140), cell(4, "5", 300, 310), cell(5, "Late:", 0, 30, 40.0)], "page int, i int, text string, x0 double, x1 double, y0 double")
    assert [(r.label, r.value, r.spacing) for r in pairs.chained_pairs(cells, ["page"], "i").collect()] == [("Name", "Ann Lee", 10.0)]
    inline = spark.createDataFrame([("A: bcd", 0.0, 60.0), ("12:30", 0.0, 9.0), ("x:", 0.0, 9.0)], "text string, x0 double, x1 double")
    assert [(r.label, r.value, r.spacing) for r in pairs.inline_pairs(inline).collect()] == [("A", "bcd", 10.0)]
    assert pairs.inline_pairs(inline, compat=True).first().spacing == 30.0


def test_alignment_of_a_block(spark):
    rows = [(0, i, "1.50", 420.0, 100.0 + 12 * i, 500.0, 110.0 + 12 * i) for i in range(25)] + [(0, 25, "9.99", 432.3, 400.0, 512.3, 410.0)]
    cells = spark.createDataFrame(rows, "page_ix int, box_id int, text string, x0 double, y0 double, x1 double, y1 double")
    blocked = alignment.assign_blocks(cells, ["page_ix"], "box_id")
    a = alignment.block_alignment(blocked, ["page_ix"], "box_id").first()
    assert (a.alignment, a.baseline) == ("right", 500.0) and a.confidence >= 0.96
    off = alignment.column_anomalies(blocked, alignment.block_alignment(blocked, ["page_ix"], "box_id"), ["page_ix"], "box_id").collect()
    assert [(r.box_id, r.deviation, r.severity) for r in off] == [(25, 12.3, "HIGH")]
    assert [r.kind for r in alignment.anomalies(cells, ["page_ix"], "box_id").collect()] == ["vertical"]


def test_reports(spark, tmp_path):
    f = spark.createDataFrame([("a/1", "k", "t", "HIGH"), ("a/1", "k", "u", "LOW"), ("b", "k", "v", "LOW")], "doc_id string, kind string, text string, severity string")
    report.write_json(report.per_document(f), str(tmp_path / "r"))
    assert {r.slug for r in spark.read.json(str(tmp_path / "r")).collect()} == {"a_1", "b"}
    assert [r.line for r in report.markdown(f).filter("doc_id = 'a/1'").orderBy("line_no").collect()] == ["# Document a/1", "2 findings", "- [HIGH] t", "- [LOW] u"]
    docs = spark.createDataFrame([("a/1",), ("b",), ("c",)], "doc_id string")
    assert tuple(report.summary(f, docs).first()) == (3, 2, 1, 0, 2)
    n = spark.createDataFrame([(float("inf"),), (1.23456,)], "x double").select(report.serialized(F.col("x")).alias("s"))
    assert [r.v for r in n.select(report.parsed(F.col("s")).alias("v")).collect()] == [1000.0, 1.2346]
