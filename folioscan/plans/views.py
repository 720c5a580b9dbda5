"""Layout views of the star-schema tables, each as a DataFrame and as the SQL of the same arithmetic.

boxes: line items as positioned boxes, 20 orders to a page. cells: words of documents in a fixed-pitch layout, 40 lines
to a page. forms: orders as label/value pairs. structure: structural items near the boxes. features: embeddings as
feature rows, 100 to a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.operators.renderings import Both, encoded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    page = F.floor(F.col("l_orderkey") / 20).cast("long")
    order = Window.partitionBy("page_ix").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x0, y0 = (F.col("l_partkey") % 50 * 10).cast("double"), (F.col("l_suppkey") % 60 * 12).cast("double")
    return t.withColumn("page_ix", page).select(
        "page_ix",
        F.row_number().over(order).cast("long").alias("box_id"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 20 + F.col("l_quantity")).alias("x1"),
        (y0 + 10).alias("y1"),
        F.concat("l_returnflag", "l_linestatus").alias("text"),
    )


BOXES = """boxes as (
  select page_ix, cast(row_number() over (partition by page_ix order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as bigint) as box_id,
    x0, y0, x0 + 20 + l_quantity as x1, y0 + 10 as y1, l_returnflag || l_linestatus as text
  from (select *, cast(l_orderkey // 20 as bigint) as page_ix, cast(l_partkey % 50 * 10 as double) as x0, cast(l_suppkey % 60 * 12 as double) as y0 from lineitem))"""


def tall_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes, tall enough to overlap the rows below: blocks join lines that share a stretch of y."""
    return boxes(spark, sf_dir).withColumn("y1", F.col("y1") + 6)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are placed line by line where their document is read: nothing is shuffled for it."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = pc.split_pattern(batch.column("line"), " ")
            words, starts = split.flatten(), split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
            of = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            n = pc.utf8_length(words).to_numpy().astype(np.int64)
            ahead = np.concatenate(([0], np.cumsum(n + 1)))
            x0 = 6.0 * (ahead[:-1] - ahead[starts[of]])
            some = np.flatnonzero(n)
            of, w = of[some], (np.arange(len(n)) - starts[of])[some].astype(np.int32)
            columns = [*(batch.column(c).take(pa.array(of)) for c in ("doc_id", "line_no")), w, words.take(pa.array(some)), x0[some], (x0 + 6 * n)[some]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "line_no", "w", "text", "x0", "x1"])

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    words = lines.mapInArrow(placed, "doc_id long, line_no int, w int, text string, x0 double, x1 double")
    y0 = (F.col("line_no") * 12).cast("double")
    return words.select("doc_id", F.floor(F.col("line_no") / 40).cast("long").alias("page_ix"), "line_no", "w", "text", "x0", y0.alias("y0"), "x1", (y0 + 10).alias("y1"))


CELLS = """cells as (
  select doc_id, cast(line_no // 40 as bigint) as page_ix, cast(line_no as integer) as line_no, cast(w as integer) as w, text, cast(6 * o as double) as x0, cast(line_no * 12 as double) as y0,
    cast(6 * o + 6 * length(text) as double) as x1, cast(line_no * 12 + 10 as double) as y1
  from (
    select *, coalesce(sum(length(text) + 1) over (partition by doc_id, line_no order by w rows between unbounded preceding and 1 preceding), 0) as o from (
      select doc_id, line_no, generate_subscripts(ws, 1) - 1 as w, unnest(ws) as text from (
        select doc_id, line_no, string_split(line, ' ') as ws from (
          select doc_id, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents)))))
  where text <> '')"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarser rendering of the cells: whole lines."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return t.filter(F.trim("text") != "")


LINES = """lines as (
  select doc_id, line_no, text from (select doc_id, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as text from (select doc_id, string_split(text, chr(10)) as ls from documents)) where trim(text) <> '')"""


def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other rendering of the cells: some lost, some with one letter changed."""
    k = F.col("doc_id") + F.col("line_no") + F.col("w")
    text = F.when(k % 13 == 0, F.concat(F.lit("x"), F.substring("text", 2, 1000000))).otherwise(F.col("text"))
    return cells(spark, sf_dir).filter(k % 17 != 0).withColumn("text", text)


#: Bytes of text that are placed at once.
_TEXT = 1 << 20


def renderings(spark: SparkSession, sf_dir: str, form: str, raw: bool = False) -> Both:
    """cells and visible, numbered in the order of lines and with texts in a form ('lower', 'normal'), as compressed pages from one scan of the documents; raw: as in renderings.paired."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("text").is_valid())
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)) if batch.num_rows else []
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _TEXT, "right")))
                yield from pages_of(batch.slice(at, stop - at))
                at = stop

    def pages_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lines = pc.split_pattern(batch.column("text"), "\n")
        line_ends = lines.offsets.to_numpy().astype(np.int64) - lines.offsets[0].as_py()
        split = pc.split_pattern(lines.flatten(), " ")
        words, starts = split.flatten(), split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        n = pc.utf8_length(words).to_numpy().astype(np.int64)
        line = np.repeat(np.arange(len(split)), np.diff(starts))
        ahead = np.concatenate(([0], np.cumsum(n + 1)))
        some = np.flatnonzero(n)
        line = line[some]
        w = some - starts[line]
        x0 = 6.0 * (ahead[some] - ahead[starts[line]])
        doc = np.repeat(np.arange(batch.num_rows), np.diff(line_ends))[line]
        line_no = line - line_ends[doc]
        boxes = np.stack([x0, 12.0 * line_no, x0 + 6 * n[some], 12.0 * line_no + 10], axis=1)
        text, ident = words.take(pa.array(some)), line_no * 1000000 + w
        key = batch.column("doc_id")
        k = pc.fill_null(key, 0).to_numpy()[doc] + line_no + w
        shown = np.flatnonzero((k % 17 != 0) & key.is_valid().to_numpy(zero_copy_only=False)[doc])
        other = text.take(pa.array(shown))
        changed = pc.binary_join_element_wise("x", pc.utf8_slice_codeunits(other, 1, 1000001), "")
        other = pc.if_else(pa.array(k[shown] % 13 == 0), changed, other)
        for at, t, is_cell in ((np.arange(len(some)), text, True), (shown, other, False)):
            if not len(at):
                continue
            new = np.diff(doc[at], prepend=-1).astype(bool) | np.diff(line_no[at] // 40, prepend=-1).astype(bool)
            first = np.flatnonzero(new)
            cuts = np.append(first, len(at))
            formed = _formed(t, form)
            texts = [formed] if not raw else [formed, pc.if_else(pc.not_equal(t, formed), t, pa.scalar(None, pa.string())) if is_cell else pa.nulls(len(t), pa.string())]
            columns = [key.take(pa.array(doc[at][first])), pa.array(line_no[at][first] // 40), pa.array([is_cell] * len(first)), pa.array(np.diff(cuts)), pa.array(encoded(cuts, pa.array(ident[at]), boxes[at], texts), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "page_ix", "_cell", "_n", "_rows"])

    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frame = documents.mapInArrow(placed, "doc_id long, page_ix long, _cell boolean, _n long, _rows binary")
    return Both(frame, ["doc_id", "page_ix"], "cell_index", ("bigint", "bigint"), 1 + raw)


def _formed(text: pa.Array, form: str) -> pa.Array:
    """lower: in lower case; normal: as functions.text.normalize."""
    if form == "normal":
        text = pc.replace_substring_regex(text, r"[ \t\n\x0B\f\r]+", " ") if pc.any(pc.match_substring_regex(text, r"[ \t\n\x0B\f\r]")).as_py() else text
    lower = pc.utf8_lower(text)
    return pc.utf8_trim(lower, " ") if form == "normal" else lower


VISIBLE = """visible as (
  select * replace (case when (doc_id + line_no + w) % 13 = 0 then 'x' || substr(text, 2) else text end as text) from cells where (doc_id + line_no + w) % 17 <> 0)"""


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    gap = F.when(F.col("o_custkey") % 11 == 0, 18.0).when(F.col("o_custkey") % 13 == 0, 4.5).otherwise(4.0)
    edge = (40 + 6 * F.length("o_orderpriority")).cast("double")
    value = F.format_string("%.2f", "o_totalprice")
    return t.select(
        F.floor(F.col("o_orderkey") / 40).cast("long").alias("page_ix"),
        F.col("o_orderkey").alias("pair_id"),
        F.concat("o_orderpriority", F.lit(":")).alias("label"),
        value.alias("value"),
        edge.alias("label_x1"),
        (edge + gap).alias("value_x0"),
        (edge + gap + 6 * F.length(value)).cast("double").alias("value_x1"),
        (F.col("o_orderkey") % 40 * 14).cast("double").alias("y0"),
        gap.alias("spacing"),
    )


FORMS = """forms as (
  select cast(o_orderkey // 40 as bigint) as page_ix, o_orderkey as pair_id, o_orderpriority || ':' as label, v as value, edge as label_x1, edge + gap as value_x0,
    cast(edge + gap + 6 * length(v) as double) as value_x1, cast(o_orderkey % 40 * 14 as double) as y0, gap as spacing
  from (select *, cast(40 + 6 * length(o_orderpriority) as double) as edge, printf('%.2f', o_totalprice) as v,
    cast(case when o_custkey % 11 = 0 then 18.0 when o_custkey % 13 = 0 then 4.5 else 4.0 end as double) as gap from orders))"""


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every box, moved by two points, as a structural item whose kind follows from its number."""
    kind = F.when(F.col("box_id") % 14 == 0, "column_header").when(F.col("box_id") % 21 == 0, "section_header").otherwise("body")
    return boxes(spark, sf_dir).select("page_ix", F.col("box_id").alias("item_id"), (F.col("x0") + 2).alias("sx0"), F.col("y0").alias("sy0"), (F.col("x1") + 2).alias("sx1"), F.col("y1").alias("sy1"), kind.alias("kind"))


STRUCTURE = """structure as (
  select page_ix, box_id as item_id, x0 + 2 as sx0, y0 as sy0, x1 + 2 as sx1, y1 as sy1,
    case when box_id % 14 = 0 then 'column_header' when box_id % 21 = 0 then 'section_header' else 'body' end as kind from boxes)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of documents: whole embeddings, 64 numbers."""
    t = table(spark, sf_dir, "embeddings")
    return t.select(F.floor(F.col("vec_id") / 100).cast("long").alias("doc"), F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.col("label").alias("cluster"))


FEATURES = """features as (
  select cast(vec_id // 100 as bigint) as doc, vec_id as id, list_transform(embedding, lambda v: cast(v as double)) as x, label as cluster from embeddings)"""


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left edges that at least three boxes of a page share, with their boxes' mean and count."""
    b = boxes(spark, sf_dir)
    return b.groupBy("page_ix", F.bround("x0").alias("bucket")).agg(F.count("*").alias("n"), F.avg("x0").alias("value")).filter("n >= 3")


BASELINES = "baselines as (select page_ix, round_even(x0, 0) as bucket, count(*) as n, avg(x0) as value from boxes group by 1, 2 having count(*) >= 3)"
