"""Payloads: one JSON file per document, read with explicit schemas; rows that don't fit keep null fields.

Bounding boxes come in four encodings (rotated quadrilateral, simple corners, left/top/right/bottom, list of four) and
two origins; all become four DOUBLE columns with a top-left origin.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import geometry as g
from folioscan.operators.lineage import cut

RECT = "struct<" + ", ".join(f"r_{c}{i}: double" for i in range(4) for c in "xy") + ", x0: double, y0: double, x1: double, y1: double, l: double, t: double, r: double, b: double, coord_origin: string>"
CELL = f"struct<text: string, rect: {RECT}, bbox: array<double>, index: int, font_name: string, font_key: string, confidence: double, from_ocr: boolean>"
PROV = f"array<struct<page_no: int, bbox: {RECT}>>"
GRID_CELL = f"struct<text: string, bbox: {RECT}, start_row_offset_idx: int, end_row_offset_idx: int, start_col_offset_idx: int, end_col_offset_idx: int, column_header: boolean, row_header: boolean, row_section: boolean>"
PAYLOAD = (
    "metadata struct<num_pages: int, total_cells: int, has_parsed_pages: boolean>, "
    f"docling_document struct<tables: array<struct<prov: {PROV}, data: struct<num_rows: int, num_cols: int, grid: array<array<{GRID_CELL}>>>>>, texts: array<struct<label: string, text: string, prov: {PROV}>>>, "
    f"parsed_pages map<string, struct<page_no: int, size: struct<width: double, height: double>, cells: array<{CELL}>, num_cells: int>>"
)
SPAN_PAYLOAD = "pages array<struct<page_no: int, blocks: array<struct<type: int, lines: array<struct<spans: array<struct<text: string, bbox: array<double>, font: string, size: double, color: int, flags: int>>>>>>>>"
ELEMENT = "Path string, Page int, Text string, Font struct<embedded: boolean, encoding: string, family_name: string, name: string, font_type: string, monospaced: boolean, subset: boolean>, HasClip boolean, TextSize double, LineHeight double, BBox array<double>"
_PLACED = "x0: double, top: double, x1: double, bottom: double"
CHARS_PAYLOAD = (
    f"source_file string, pages array<struct<page_number: int, width: double, height: double, rotation: int, text: string, chars: array<struct<text: string, fontname: string, size: double, {_PLACED}, upright: boolean>>, "
    f"lines: array<struct<{_PLACED}, linewidth: double>>, rects: array<struct<{_PLACED}, linewidth: double, fill: boolean>>, curves: array<struct<{_PLACED}>>, images: array<struct<{_PLACED}, name: string>>, words: array<struct<text: string, {_PLACED}>>>>"
)
WORDS_PAYLOAD = f"source_file string, pages array<struct<page_number: int, width: double, height: double, rotation: int, text: string, words: array<struct<text: string, fontname: string, size: double, {_PLACED}>>, tables: array<struct<table_index: int, data: array<array<string>>>>>>"
SPAN_PAGES = (
    "source_file string, pages array<struct<page_number: int, page_no: int, width: double, height: double, rotation: int, text: string, "
    "blocks: array<struct<type: int, lines: array<struct<bbox: array<double>, spans: array<struct<text: string, bbox: array<double>, font: string, size: double, color: int, flags: int>>>>>>, "
    "text_blocks: array<array<string>>, words: array<array<string>>, images: array<struct<xref: int, width: int, height: int, bpc: int, colorspace: string, name: string>>, "
    "links: array<struct<uri: string, kind: int>>, drawings: array<struct<type: string, width: double>>>>"
)
ELEMENTS_PAYLOAD = (
    "elements array<struct<Path: string, Page: int, Text: string, Font: struct<embedded: boolean, encoding: string, family_name: string, name: string, font_type: string, monospaced: boolean, subset: boolean>, "
    "HasClip: boolean, TextSize: double, LineHeight: double, BBox: string, attributes: struct<BBox: string>, Bounds: string>>"
)
_SUMMARY = "mean: double, std: double, q1: double, median: double, q3: double, p95: double, p99: double, max: double"
ENHANCED_PAYLOAD = (
    "elements array<struct<cell_data: struct<text: string>, pillow_analysis: struct<foreground_color: array<double>, background_color: array<double>, text_to_background_ratio: double>, "
    f"edge_gradient_analysis: struct<full_bbox: struct<summary_stats: struct<{_SUMMARY}>, frequency_energy: struct<high_freq: double, low_freq: double, high_to_low_ratio: string>, "
    "laplacian: struct<mean: double, std: double, max: double, p95: double, zero_crossings: double>, local_variance: struct<mean: double, std: double, max: double>, bilateral: struct<difference_mean: double, edge_preservation: double>>>>>"
)
OCR_PAYLOAD = "pages array<struct<page_number: int, width: double, height: double, lines: array<struct<content: string, polygon: array<double>, words: array<struct<content: string, confidence: double>>>>>>"


def listing(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Documents of a folder without their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length").withColumn("doc_id", stem(F.col("path")))


def stem(path: Column) -> Column:
    """The name without folder and extension; Spark gives names percent-encoded."""
    return F.regexp_extract(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"([^/]+?)(?:\.[^./]*)?$", 1)


def read(spark: SparkSession, path: str, schema: str = PAYLOAD) -> DataFrame:
    """A row per payload file, with doc_id from its name and _error where it isn't JSON of this shape."""
    raw = spark.read.text(path, wholetext=True).withColumn("doc_id", stem(F.col("_metadata.file_name"))).withColumn("_size", F.col("_metadata.file_size"))
    parsed = raw.withColumn("p", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select("doc_id", F.col("_size").alias("file_size"), "p.*").withColumn("_error", F.when(F.col("_corrupt").isNotNull(), "malformed")).drop("_corrupt")


def latest(payloads: DataFrame) -> DataFrame:
    """The newest version of each document, file names being <stem>_<timestamp>."""
    name = F.regexp_extract("doc_id", r"^(.*?)(?:_(\d{8}_\d{6}))?$", 1)
    return payloads.withColumn("name", name).groupBy("name").agg(F.max_by(F.struct(*payloads.columns), "doc_id").alias("p")).select("name", "p.*")


def rect_box(r: Column, bbox: Column | None = None, height: Column | None = None) -> list[Column]:
    """Four columns from whichever encoding is there; bottom-left boxes are flipped where the page height is known."""
    quad = g.from_quad([r[f"r_x{i}"] for i in range(4)], [r[f"r_y{i}"] for i in range(4)])
    simple = [r["x0"], r["y0"], r["x1"], r["y1"]]
    ltrb = [r["l"], F.least(r["t"], r["b"]), r["r"], F.greatest(r["t"], r["b"])]
    listed = [F.get(bbox, F.lit(i)) for i in range(4)] if bbox is not None else [F.lit(None).cast("double")] * 4
    box = [F.coalesce(q, s, e, i) for q, s, e, i in zip(quad, simple, ltrb, listed, strict=True)]
    box = g.from_corners(*box)
    if height is None:
        return box
    below = (r["coord_origin"] == "BOTTOMLEFT") & height.isNotNull()
    return [F.when(below, f).otherwise(b) for f, b in zip(g.flip(box, height), box, strict=True)]


def cells(payloads: DataFrame) -> DataFrame:
    """One row per cell that has a text and a box; cell_index keeps the order of the payload. Pages without size are 612 x 792."""
    pages = payloads.select("doc_id", F.explode("parsed_pages").alias("key", "page")).select(
        "doc_id", F.coalesce("page.page_no", F.col("key").cast("int")).alias("page_ix"), F.coalesce("page.size.width", F.lit(612.0)).alias("width"), F.coalesce("page.size.height", F.lit(792.0)).alias("height"), F.posexplode("page.cells").alias("cell_index", "c")
    )
    box = rect_box(F.col("c.rect"), F.col("c.bbox"), F.col("height"))
    named = pages.select(
        "doc_id", "page_ix", "width", "height", "cell_index", F.trim("c.text").alias("text"), *[b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)],
        F.coalesce("c.font_name", F.lit("Unknown")).alias("font_name"), F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("c.from_ocr", F.lit(False)).alias("from_ocr"),
    )
    return named.filter("text <> '' and x0 is not null and y0 is not null and x1 is not null and y1 is not null")


def _page_ix(number: Column) -> Column:
    """Structural page numbers count from 1."""
    return F.when(number > 0, number - 1).otherwise(number)


def _heights(payloads: DataFrame) -> DataFrame:
    """(doc_id, page_ix, _height) of the pages that say how high they are."""
    pages = payloads.select("doc_id", F.explode("parsed_pages").alias("key", "page"))
    return pages.select("doc_id", F.coalesce("page.page_no", F.col("key").cast("int")).alias("page_ix"), F.col("page.size.height").alias("_height")).dropDuplicates(["doc_id", "page_ix"])


def _with_height(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    return rows.join(_heights(payloads), ["doc_id", "page_ix"], "left").withColumn("_height", F.coalesce("_height", F.lit(792.0)))


def table_cells(payloads: DataFrame, compat: bool = False) -> DataFrame:
    """Grid cells of every table: doc_id, page_ix, table_id, rows and columns, box (top left origin; compat: as given), text, kind."""
    t = payloads.select("doc_id", F.posexplode("docling_document.tables").alias("table_id", "t")).select("doc_id", "table_id", _page_ix(F.get(F.col("t.prov"), F.lit(0))["page_no"]).alias("page_ix"), F.explode(F.flatten("t.data.grid")).alias("c"))
    kind = F.when(F.col("c.column_header"), "column_header").when(F.col("c.row_header"), "row_header").otherwise("body")
    box = rect_box(F.col("c.bbox"), height=None if compat else F.col("_height"))
    return _with_height(t, payloads).select("doc_id", "page_ix", "table_id", F.col("c.start_row_offset_idx").alias("row"), F.col("c.start_col_offset_idx").alias("column"), F.col("c.text").alias("text"), *[b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)], kind.alias("kind"))


def tables(payloads: DataFrame) -> DataFrame:
    """Tables as the union of their cells' boxes."""
    return table_cells(payloads).groupBy("doc_id", "page_ix", "table_id").agg(F.min("x0").alias("tx0"), F.min("y0").alias("ty0"), F.max("x1").alias("tx1"), F.max("y1").alias("ty1"), F.count("*").alias("cells"))


def structure(payloads: DataFrame) -> DataFrame:
    """Table cells and labelled texts as structural items."""
    texts = payloads.select("doc_id", F.explode("docling_document.texts").alias("t")).select("doc_id", F.explode("t.prov").alias("p"), F.col("t.label").alias("kind")).withColumn("page_ix", _page_ix(F.col("p.page_no")))
    box = rect_box(F.col("p.bbox"), height=F.col("_height"))
    names = ("sx0", "sy0", "sx1", "sy1")
    labelled = _with_height(texts, payloads).select("doc_id", "page_ix", *[b.alias(n) for b, n in zip(box, names, strict=True)], "kind")
    gridded = table_cells(payloads).select("doc_id", "page_ix", *[F.col(c).alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), names, strict=True)], "kind")
    return labelled.unionByName(gridded)


def structure_blocks(payloads: DataFrame) -> DataFrame:
    """Columns of tables and paragraphs as layout blocks: doc_id, page_ix, kind, table_id, column_ix, box, text (first 50 characters).

    A table has the columns of its first row, each the union of its cells' boxes by their place in the row; page and box of
    a paragraph are those of its first provenance that has a page. Blocks without a page or a box are left out.
    """
    at = lambda prov: F.get(F.filter(prov, lambda p: p["page_no"].isNotNull()), F.lit(0))
    t = payloads.select("doc_id", F.posexplode("docling_document.tables").alias("table_id", "t")).select("doc_id", "table_id", _page_ix(at(F.col("t.prov"))["page_no"]).alias("page_ix"), F.size(F.get(F.col("t.data.grid"), F.lit(0))).alias("n"), F.explode("t.data.grid").alias("row"))
    cells = _with_height(t.select("doc_id", "table_id", "page_ix", "n", F.posexplode("row").alias("column_ix", "c")).filter("column_ix < n"), payloads)
    names = ("x0", "y0", "x1", "y1")
    placed = cells.select("doc_id", "page_ix", "table_id", "column_ix", *[b.alias(n) for b, n in zip(rect_box(F.col("c.bbox"), height=F.col("_height")), names, strict=True)])
    columns = placed.filter("x0 is not null").groupBy("doc_id", "page_ix", "table_id", "column_ix").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    columns = columns.select("doc_id", "page_ix", F.lit("table_column").alias("kind"), "table_id", "column_ix", *names, F.lit("").alias("text"))
    x = payloads.select("doc_id", F.explode("docling_document.texts").alias("t")).select("doc_id", F.coalesce("t.text", F.lit("")).alias("text"), at(F.col("t.prov")).alias("p"))
    x = _with_height(x.withColumn("page_ix", _page_ix(F.col("p.page_no"))), payloads)
    none = F.lit(None).cast("int")
    paragraphs = x.select("doc_id", "page_ix", F.lit("paragraph").alias("kind"), none.alias("table_id"), none.alias("column_ix"), *[b.alias(n) for b, n in zip(rect_box(F.col("p.bbox"), height=F.col("_height")), names, strict=True)], F.left("text", F.lit(50)).alias("text"))
    return columns.unionByName(paragraphs).filter("page_ix is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null")


def spans(payloads: DataFrame) -> DataFrame:
    """Text spans of type-0 blocks with unpacked colors, numbered through the page."""
    p = payloads.select("doc_id", F.explode("pages").alias("p"))
    each = F.transform(F.filter("p.blocks", lambda b: b["type"] == 0), lambda b: F.flatten(F.array_compact(F.transform(b["lines"], lambda x: x["spans"]))))
    s = p.select("doc_id", (F.col("p.page_no") - 1).alias("page_ix"), F.posexplode(F.flatten(F.array_compact(each))).alias("span_index", "s"))
    red, green, blue = g.unpack_color(F.col("s.color"))
    return s.select("doc_id", "page_ix", "span_index", F.col("s.text").alias("text"), *[F.get("s.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.col("s.font").alias("font"), F.col("s.size").alias("size"), red.alias("red"), green.alias("green"), blue.alias("blue"))


def ocr_cells(payloads: DataFrame) -> DataFrame:
    """Lines of an OCR result, inches to points; confidence is the mean of the words', 0 without words."""
    p = payloads.select("doc_id", F.explode("pages").alias("p")).select("doc_id", (F.col("p.page_number") - 1).alias("page_ix"), F.posexplode("p.lines").alias("cell_index", "l"))
    xs, ys = F.filter("l.polygon", lambda x, i: i % 2 == 0), F.filter("l.polygon", lambda x, i: i % 2 == 1)
    n = F.size("l.words")
    confidence = F.when(n > 0, F.aggregate("l.words", F.lit(0.0), lambda s, w: s + w["confidence"]) / n).otherwise(0.0)
    return p.select("doc_id", "page_ix", "cell_index", F.col("l.content").alias("text"), (F.array_min(xs) * 72).alias("x0"), (F.array_min(ys) * 72).alias("y0"), (F.array_max(xs) * 72).alias("x1"), (F.array_max(ys) * 72).alias("y1"), confidence.alias("confidence"))


def chars(payloads: DataFrame) -> DataFrame:
    """Characters of a character payload: doc_id, page_ix, char_index, text, font, size, box."""
    p = payloads.select("doc_id", F.explode("pages").alias("p")).select("doc_id", (F.col("p.page_number") - 1).alias("page_ix"), F.posexplode("p.chars").alias("char_index", "c"))
    return p.select("doc_id", "page_ix", "char_index", F.col("c.text").alias("text"), F.col("c.fontname").alias("font"), F.col("c.size").alias("size"), F.col("c.x0").alias("x0"), F.col("c.top").alias("y0"), F.col("c.x1").alias("x1"), F.col("c.bottom").alias("y1"))


def shapes(payloads: DataFrame) -> DataFrame:
    """Lines, rectangles, curves and images of a character payload with their kind and box."""
    kinds = {"line": "lines", "rect": "rects", "curve": "curves", "image": "images"}
    each = [F.expr(f"transform(coalesce(p.{c}, array()), x -> named_struct('kind', '{k}', 'x0', x.x0, 'y0', x.top, 'x1', x.x1, 'y1', x.bottom))") for k, c in kinds.items()]
    p = payloads.select("doc_id", F.explode("pages").alias("p"))
    return p.select("doc_id", (F.col("p.page_number") - 1).alias("page_ix"), F.explode(F.concat(*each)).alias("s")).select("doc_id", "page_ix", "s.*")


def words(payloads: DataFrame) -> DataFrame:
    """Words of a word payload (or of a character payload, which has no fonts for them)."""
    p = payloads.select("doc_id", F.explode("pages").alias("p")).select("doc_id", (F.col("p.page_number") - 1).alias("page_ix"), F.posexplode("p.words").alias("word_index", "w"))
    named = "fontname" in p.select("w.*").columns
    font = [F.col("w.fontname").alias("font"), F.col("w.size").alias("size")] if named else [F.lit(None).cast("string").alias("font"), F.lit(None).cast("double").alias("size")]
    return p.select("doc_id", "page_ix", "word_index", F.col("w.text").alias("text"), *font, F.col("w.x0").alias("x0"), F.col("w.top").alias("y0"), F.col("w.x1").alias("x1"), F.col("w.bottom").alias("y1"))


def word_tables(payloads: DataFrame) -> DataFrame:
    """Cells of the tables of a word payload: doc_id, page_ix, table_id, row, column, text."""
    p = payloads.select("doc_id", F.explode("pages").alias("p")).select("doc_id", (F.col("p.page_number") - 1).alias("page_ix"), F.explode("p.tables").alias("t"))
    rows = p.select("doc_id", "page_ix", F.col("t.table_index").alias("table_id"), F.posexplode("t.data").alias("row", "r"))
    return rows.select("doc_id", "page_ix", "table_id", "row", F.posexplode("r").alias("column", "text"))


def layout_blocks(payloads: DataFrame) -> DataFrame:
    """Text blocks (x0, y0, x1, y1, text, ...) of a span payload as boxes with their first 50 characters; others are left out."""
    p = payloads.select("doc_id", F.explode("pages").alias("p")).select("doc_id", (F.coalesce("p.page_number", F.lit(1)) - 1).alias("page_ix"), F.posexplode("p.text_blocks").alias("block_index", "b"))
    numbers = [F.get("b", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return p.select("doc_id", "page_ix", "block_index", *numbers, F.left(F.coalesce(F.get("b", F.lit(4)), F.lit("")), F.lit(50)).alias("text")).filter("x0 is not null and y0 is not null and x1 is not null and y1 is not null")


def span_words(payloads: DataFrame) -> DataFrame:
    """Words (x0, y0, x1, y1, text, ...) of a span payload."""
    p = payloads.select("doc_id", F.explode("pages").alias("p")).select("doc_id", (F.coalesce("p.page_number", F.lit(1)) - 1).alias("page_ix"), F.posexplode("p.words").alias("word_index", "w"))
    return p.select("doc_id", "page_ix", "word_index", *[F.get("w", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.get("w", F.lit(4)).alias("text"))


def page_objects(payloads: DataFrame) -> DataFrame:
    """Per page of a span payload: size, rotation, and how many images, links and drawings it has."""
    p = payloads.select("doc_id", F.explode("pages").alias("p"))
    n = lambda c: F.coalesce(F.size(F.col(f"p.{c}")), F.lit(0)).alias(c)
    return p.select("doc_id", (F.coalesce("p.page_number", F.lit(1)) - 1).alias("page_ix"), F.col("p.width").alias("width"), F.col("p.height").alias("height"), F.col("p.rotation").alias("rotation"), n("images"), n("links"), n("drawings"))


def any_box(text: Column) -> list[Column]:
    """A box given as JSON: a list of four, {x0, y0, x1, y1} or {l, t, r, b}, corners in either order; nulls for anything else."""
    listed = F.from_json(text, "array<double>")
    named = F.from_json(text, "x0 double, y0 double, x1 double, y1 double, l double, t double, r double, b double")
    each = [F.coalesce(F.when(F.size(listed) >= 4, F.get(listed, F.lit(i))), named[a], named[b]) for i, (a, b) in enumerate((("x0", "l"), ("y0", "t"), ("x1", "r"), ("y1", "b")))]
    known = each[0].isNotNull() & each[1].isNotNull() & each[2].isNotNull() & each[3].isNotNull()
    return [F.when(known, c) for c in g.from_corners(*each)]


def elements(payloads: DataFrame) -> DataFrame:
    """Elements of an element payload; the box is the first of BBox, attributes.BBox and Bounds that is one."""
    e = payloads.select("doc_id", F.posexplode("elements").alias("element_index", "e"))
    sources = [any_box(F.col(c)) for c in ("e.BBox", "e.attributes.BBox", "e.Bounds")]
    whole = [F.struct(*[c.alias(n) for c, n in zip(s, ("x0", "y0", "x1", "y1"), strict=True)]) for s in sources]
    first = F.coalesce(*[F.when(s[0].isNotNull(), w) for s, w in zip(sources, whole, strict=True)])
    which = F.coalesce(*[F.when(s[0].isNotNull(), F.lit(n)) for s, n in zip(sources, ("BBox", "attributes.BBox", "Bounds"), strict=True)])
    kind = F.element_at(F.split("e.Path", "/"), -1)
    return e.select(
        "doc_id", "element_index", F.col("e.Path").alias("path"), F.regexp_replace(kind, r"\[\d+\]$", "").alias("kind"), F.col("e.Page").alias("page_ix"), F.col("e.Text").alias("text"), F.col("e.Font").alias("font"),
        F.col("e.HasClip").alias("has_clip"), F.col("e.TextSize").alias("text_size"), F.col("e.LineHeight").alias("line_height"), which.alias("bbox_source"), first.alias("_b"),
    ).select("*", "_b.*").drop("_b")


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """A row per element file: doc_id, file_size and the whole file as VARIANT, whatever its depth; _error where it isn't JSON."""
    raw = spark.read.text(path, wholetext=True).select("value", stem(F.col("_metadata.file_name")).alias("doc_id"), F.col("_metadata.file_size").alias("file_size"))
    return raw.select("doc_id", "file_size", F.try_parse_json("value").alias("tree")).withColumn("_error", F.when(F.col("tree").isNull(), "malformed"))


#: Levels of a tree that are read at once, typed; what lies deeper stays VARIANT until the next pass.
_LEVELS = 3
_FONT = "struct<embedded:boolean,encoding:string,family_name:string,name:string,font_type:string,monospaced:boolean,subset:boolean>"
_NODE = f"Path:string,Page:variant,Text:string,Font:{_FONT},HasClip:boolean,TextSize:double,LineHeight:variant,attributes:struct<LineHeight:double,BBox:variant>,BBox:variant,Bounds:variant"


def _shape(children: str) -> str:
    kind = "variant"
    for _ in range(_LEVELS):
        kind = f"struct<{_NODE},`{children}`:array<{kind}>>"
    return kind


def nested_elements(trees: DataFrame, children: str = "Kids") -> DataFrame:
    """Elements of trees (doc_id, tree) and all their descendants, with the page of the nearest ancestor that names one.

    place holds the positions from the root down (in this order elements stand as in the file), id and parent are its
    text. A pass reads some levels of every tree with all their fields, so that no field is looked up by itself and no
    subtree is copied for each level above it; what isn't an object has no element. An element whose page is null hands
    null down.
    """
    shape = _shape(children)
    at = trees.select("doc_id", F.posexplode(F.try_variant_get(F.col("tree"), "$.elements", f"array<{shape}>")).alias("i", "node"))
    now = at.select("doc_id", F.array("i").alias("place"), F.lit(None).cast("int").alias("above"), "node")
    levels = []
    while True:
        now = cut(now.filter("node is not null"))  # what isn't an object
        if levels and now.isEmpty():
            break
        for _ in range(_LEVELS):
            page = F.when(F.col("node.Page").isNull(), F.col("above")).otherwise(F.try_variant_get("node.Page", "$", "int"))
            below = F.col("node").getField(children)
            levels.append(now.select("doc_id", "place", page.alias("page_ix"), F.col("node").dropFields(f"`{children}`").alias("node")))
            kids = now.select("doc_id", "place", page.alias("above"), F.posexplode(below).alias("i", "node")).filter("node is not null")
            now = kids.select("doc_id", F.array_append("place", F.col("i")).alias("place"), "above", "node")
        now = now.withColumn("node", F.try_variant_get("node", "$", shape))
    whole = functools.reduce(DataFrame.union, levels)
    return _element(whole if len(levels) == _LEVELS else cut(whole))  # else fields are read by code of their own for each level of a deep tree


def _element(level: DataFrame) -> DataFrame:
    places = {"BBox": "node.BBox", "attributes.BBox": "node.attributes.BBox", "Bounds": "node.Bounds"}
    sources = [any_box(F.to_json(p)) for p in places.values()]
    whole = [F.when(s[0].isNotNull(), F.struct(*[c.alias(n) for c, n in zip(s, ("x0", "y0", "x1", "y1"), strict=True)])) for s in sources]
    which = F.coalesce(*[F.when(s[0].isNotNull(), F.lit(p)) for s, p in zip(sources, places, strict=True)])
    kind = F.regexp_replace(F.element_at(F.split("node.Path", "/"), -1), r"\[\d+\]$", "")
    n = F.size("place")
    no_height = F.col("node.LineHeight").isNull() | F.is_variant_null("node.LineHeight")
    font = F.struct(*[F.col(f"node.Font.{c}").alias(c) for c in ("embedded", "encoding", "family_name", "name", "font_type", "monospaced", "subset")])
    return level.select(
        "doc_id", F.array_join("place", ".").alias("id"), F.when(n > 1, F.array_join(F.slice("place", 1, n - 1), ".")).alias("parent"), "place", (n - 1).alias("depth"), "page_ix", F.col("node.Path").alias("path"), kind.alias("kind"),
        F.col("node.Text").alias("text"), font.alias("font"), F.col("node.HasClip").alias("has_clip"), F.col("node.TextSize").alias("text_size"),
        F.when(no_height, F.col("node.attributes.LineHeight")).otherwise(F.try_variant_get("node.LineHeight", "$", "double")).alias("line_height"), which.alias("bbox_source"), F.coalesce(*whole).alias("_b"),
    ).select("*", "_b.*").drop("_b")


def element_histogram(payloads: DataFrame) -> DataFrame:
    """Per document: the kinds of its elements (the last part of their paths, numbers aside) and how many there are."""
    return elements(payloads).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def feature_rows(payloads: DataFrame) -> DataFrame:
    """(doc, id, text, x, names): the 26 features of each element of an enhanced payload, in the order of appearance.FEATURES.

    What is missing is 0 (a white background, a black foreground); an infinite ratio is 1000.
    """
    from folioscan.operators.appearance import FEATURES, RATIO_CAP

    e = payloads.select(F.col("doc_id").alias("doc"), F.posexplode("elements").alias("id", "e"))
    colors = [F.coalesce(F.col("e.pillow_analysis.foreground_color"), F.array(*[F.lit(0.0)] * 3)), F.coalesce(F.col("e.pillow_analysis.background_color"), F.array(*[F.lit(255.0)] * 3))]
    channels = [[F.coalesce(F.get(c, F.lit(i)), F.lit(0.0)) for i in range(3)] for c in colors]
    full = "e.edge_gradient_analysis.full_bbox"
    number = lambda path: F.coalesce(F.col(path), F.lit(0.0))
    ratio = F.col(f"{full}.frequency_energy.high_to_low_ratio")
    ratio = F.when(ratio == "Infinity", RATIO_CAP).otherwise(F.coalesce(ratio.try_cast("double"), F.lit(0.0)))
    values = [
        g.luminance(*channels[0]), g.packed_color(*channels[0]), g.luminance(*channels[1]), g.packed_color(*channels[1]), number("e.pillow_analysis.text_to_background_ratio"),
        *[number(f"{full}.summary_stats.{k}") for k in ("mean", "std", "q1", "median", "q3", "p95", "p99", "max")],
        number(f"{full}.frequency_energy.high_freq"), number(f"{full}.frequency_energy.low_freq"), F.when(ratio == float("inf"), RATIO_CAP).otherwise(ratio),
        *[number(f"{full}.laplacian.{k}") for k in ("mean", "std", "max", "p95", "zero_crossings")], *[number(f"{full}.local_variance.{k}") for k in ("mean", "std", "max")],
        number(f"{full}.bilateral.difference_mean"), number(f"{full}.bilateral.edge_preservation"),
    ]
    return e.select("doc", F.col("id").cast("long").alias("id"), F.coalesce("e.cell_data.text", F.lit("")).alias("text"), F.array(*[v.cast("double") for v in values]).alias("x"), F.array(*[F.lit(n) for n in FEATURES]).alias("names"))


def with_text(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_ix) with has_text and the first 200 characters of their cells, in order."""
    order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell_index", "text"))), lambda x: x["text"]), " ")
    told = cells.filter(F.trim("text") != "").groupBy("doc_id", "page_ix").agg(F.left(order, F.lit(200)).alias("preview"))
    return pages.join(told, ["doc_id", "page_ix"], "left").withColumn("has_text", F.col("preview").isNotNull()).fillna("", ["preview"])


def table_checks(payloads: DataFrame) -> DataFrame:
    """Per table: its box as given, width, height and area, rows, columns and cells, up to ten texts of its first three rows and columns, and a warning where its top lies below its bottom."""
    t = payloads.select("doc_id", F.posexplode("docling_document.tables").alias("table_id", "t")).withColumn("p", F.get(F.col("t.prov"), F.lit(0)))
    width, height = F.col("p.bbox.r") - F.col("p.bbox.l"), F.col("p.bbox.b") - F.col("p.bbox.t")
    near = F.flatten(F.transform(F.slice(F.coalesce("t.data.grid", F.array()), 1, 3), lambda row, i: F.transform(F.slice(row, 1, 3), lambda c, j: F.when(F.trim(c["text"]) != "", F.format_string("[%d,%d]: %s", i, j, F.left(F.trim(c["text"]), F.lit(50)))))))
    inverted = F.col("p.bbox.t") > F.col("p.bbox.b")
    return t.select(
        "doc_id", "table_id", _page_ix(F.col("p.page_no")).alias("page_ix"), *[F.col(f"p.bbox.{c}").alias(c) for c in "ltrb"], F.round(width, 2).alias("width"), F.round(height, 2).alias("height"), F.round(width * height, 2).alias("area"),
        F.size("t.data.grid").alias("n_rows"), F.size(F.get(F.col("t.data.grid"), F.lit(0))).alias("n_columns"), F.size(F.flatten("t.data.grid")).alias("n_cells"), F.slice(F.array_compact(near), 1, 10).alias("samples"),
        F.when(inverted, "top below bottom (y axis inverted?)").alias("warning"),
    )


def first_match(payloads: DataFrame, part: str) -> DataFrame:
    """The payload whose name holds the part, the first in order of names."""
    return payloads.filter(F.lower("doc_id").contains(part.lower())).orderBy("doc_id").limit(1)


def flatten_elements(rows: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Elements given as (doc_id, id, parent, page, ...) with their depth; children without a page take their parent's.

    Parents are looked up in doubling steps: after k rounds every element knows its ancestor 2 ** k levels up, the depth
    so far and the nearest page on the way, so a tree of depth n takes log2(n) joins. Elements below an unknown parent
    are left out, and so is what `most` levels don't bring to a root: cycles and what hangs on them.
    """
    known = rows.select("doc_id", "id", "parent", "page")
    now = known.select("doc_id", "id", F.col("parent").alias("up"), "page", F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    step = 1
    while True:
        now = cut(now)
        if step > most or now.filter("up is not null").isEmpty():
            now = now.filter("up is null")
            break
        above = now.select(F.col("doc_id").alias("_d"), F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("page").alias("_page"), F.col("depth").alias("_depth"))
        j = now.join(above, (F.col("doc_id") == F.col("_d")) & (F.col("up") == F.col("_id")), "left")
        orphan = F.col("up").isNotNull() & F.col("_id").isNull()
        now = j.filter(~orphan).select("doc_id", "id", F.col("_up").alias("up"), F.coalesce("page", "_page").alias("page"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
        step *= 2
    return known.select("doc_id", "id", "parent").join(now.select("doc_id", "id", "page", "depth"), ["doc_id", "id"]).select("doc_id", "id", "parent", "page", "depth")


def pending(listed: DataFrame, done: DataFrame) -> DataFrame:
    """Documents that have no result yet."""
    return listed.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


def permissions(flags: DataFrame) -> DataFrame:
    """has_restrictions and a note from boolean columns print, copy, modify, annotate (null: allowed)."""
    names = ("print", "copy", "modify", "annotate")
    denied = F.array_compact(F.array(*[F.when(F.coalesce(F.col(n), F.lit(True)), F.lit(None)).otherwise(F.lit(n)) for n in names]))
    return flags.withColumn("has_restrictions", F.size(denied) > 0).withColumn("note", F.when(F.size(denied) > 0, F.concat(F.lit("not allowed: "), F.array_join(denied, ", "))).otherwise("no restrictions"))
