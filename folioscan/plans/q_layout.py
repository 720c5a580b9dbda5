"""Queries over boxes: geometry, overlap joins, edges, islands, baselines, blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions import geometry as g
from folioscan.operators import alignment, baselines, blocks, kernels, lookups, pages, spatial
from folioscan.operators.lineage import stored
from folioscan.plans import views as v
from folioscan.plans.registry import query

_PAIR = "from boxes a join boxes b on a.page_ix = b.page_ix and a.box_id < b.box_id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1"
_I = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_A, _B = "(a.x1 - a.x0) * (a.y1 - a.y0)", "(b.x1 - b.x0) * (b.y1 - b.y0)"
_IOU_PAIRS = f"with {v.BOXES} select * from (select a.page_ix, a.box_id as a, b.box_id as b, round({_I} / ({_A} + {_B} - {_I}), 6) as score {_PAIR}) where score >= 0.1"


@query(_IOU_PAIRS)
def iou_overlap_pairs(spark, d):
    return spatial.overlapping_pairs(v.boxes(spark, d), 0.10).withColumn("score", F.round("score", 6))


@query(_IOU_PAIRS)
def grid_equals_theta(spark, d):
    """The same pairs from other bins."""
    return spatial.overlapping_pairs(v.boxes(spark, d), 0.10, bins=(30.0, 30.0)).withColumn("score", F.round("score", 6))


@query(f"""with {v.BOXES}, p as (select a.page_ix, a.box_id as a, b.box_id as b, {_I} as i, {_A} as aa, {_B} as ab {_PAIR})
select page_ix, a, b, round(i / least(aa, ab), 6) as score_min, round(i / (aa + ab - i), 6) as score_iou, round(i / aa, 6) as score_a, round(i / ab, 6) as score_b from p""")
def overlap_modes(spark, d):
    p = spatial.pair_scores(v.boxes(spark, d))
    return p.select("page_ix", "a", "b", *[F.round(f"score_{m}", 6).alias(f"score_{m}") for m in ("min", "iou", "a", "b")])


@query(f"""with {v.BOXES}, p as (select a.page_ix, a.box_id as a, b.box_id as b, {_I} as i, {_A} as aa, {_B} as ab {_PAIR})
select page_ix, a, b, round(i, 2) as intersection_area, round(aa + ab - i, 2) as union_area, round(i / (aa + ab - i), 3) as iou, round(i / aa, 3) as overlap_ratio_1, round(i / ab, 3) as overlap_ratio_2 from p""")
def bbox_overlap_metrics(spark, d):
    return spatial.pair_scores(v.boxes(spark, d)).select("page_ix", "a", "b", "intersection_area", "union_area", "iou", "overlap_ratio_1", "overlap_ratio_2")


@query(f"""with {v.BOXES} select page_ix, box_id, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy, (x1 - x0) * (y1 - y0) as area, least(abs(x0), abs(612 - x0)) as edge,
  case when y0 < 198 then 'top' when y0 > 594 then 'bottom' else 'middle' end as position, round(cast(0.299 as double) * (box_id % 256) + cast(0.587 as double) * (page_ix % 256) + cast(0.114 as double) * 7, 6) as luminance,
  (box_id % 256) * 65536 + (page_ix % 256) * 256 + 7 as packed, 792 - y1 as flipped_y0, 792 - y0 as flipped_y1 from boxes""")
def box_projections(spark, d):
    b, box = v.boxes(spark, d), g.box()
    cx, cy = g.center(box)
    r, gr = F.col("box_id") % 256, F.col("page_ix") % 256
    flipped = g.flip(box, F.lit(792.0))
    return b.select(
        "page_ix", "box_id", cx.alias("cx"), cy.alias("cy"), g.area(box).alias("area"), g.edge_proximity(F.col("x0"), F.lit(612.0)).alias("edge"), g.page_position(F.col("y0"), F.lit(792.0)).alias("position"),
        F.round(g.luminance(r, gr, F.lit(7)), 6).alias("luminance"), g.packed_color(r, gr, F.lit(7)).alias("packed"), flipped[1].alias("flipped_y0"), flipped[3].alias("flipped_y1"),
    )


@query("""select page_ix, dpis[len(dpis) // 2 + 1] as effective_dpi from (
  select cast(p_partkey // 20 as bigint) as page_ix, list_sort(list((p_size * 10 + 72 + p_size * 5 + 72) / 2.0)) as dpis from part group by 1)""")
def effective_dpi(spark, d):
    """The upper median of the images' mean of horizontal and vertical resolution."""
    dpi = ((F.col("p_size") * 10 + 72 + F.col("p_size") * 5 + 72) / 2).cast("double")
    return v.table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 20).cast("long").alias("page_ix")).agg(g.upper_median(F.collect_list(dpi)).alias("effective_dpi"))


@query("""select p_partkey, least(abs(f), abs(f - 0.25), abs(f - 0.5), abs(f - 0.75)) <= 1e-4 as regular from (
  select p_partkey, round(p_size / 8.0, 4) - floor(round(p_size / 8.0, 4)) as f from part)""")
def regular_measurement(spark, d):
    return v.table(spark, d, "part").select("p_partkey", g.is_regular(F.col("p_size") / 8).alias("regular"))


@query(f"""with {v.BOXES} select page_ix, box_id, text from boxes a where not exists (
  select 1 from boxes o where o.page_ix = a.page_ix and a.x0 >= o.x0 - 0.5 and a.y0 >= o.y0 - 0.5 and a.x1 <= o.x1 + 0.5 and a.y1 <= o.y1 + 0.5
    and ((o.x1 - o.x0) * (o.y1 - o.y0) > (a.x1 - a.x0) * (a.y1 - a.y0) or ((o.x1 - o.x0) * (o.y1 - o.y0) = (a.x1 - a.x0) * (a.y1 - a.y0) and o.box_id < a.box_id))
    and contains(lower(o.text), lower(a.text)))""")
def containment_consolidate(spark, d):
    return spatial.consolidate(v.boxes(spark, d)).select("page_ix", "box_id", "text")


@query()
def containment_consolidate_exact(spark, d):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        page, rows = kernels.rows_of(batch.column("rows"))
        keep = np.flatnonzero(pages.consolidated(page, pages.boxes_of(rows), rows["text"]))
        return pa.RecordBatch.from_arrays([batch.column("page_ix").take(pa.array(page[keep])), *(rows[c].take(pa.array(keep)) for c in ("box_id", "text"))], ["page_ix", "box_id", "text"])

    return kernels.many_pages(kernels.packed_pages(v.boxes(spark, d), ["page_ix"], "box_id"), kernel, "page_ix long, box_id long, text string")


_BEST = """m as (
  select b.page_ix, b.box_id, s.item_id, s.kind, (least(b.x1, s.sx1) - greatest(b.x0, s.sx0)) * (least(b.y1, s.sy1) - greatest(b.y0, s.sy0)) as i, (b.x1 - b.x0) * (b.y1 - b.y0) + (s.sx1 - s.sx0) * (s.sy1 - s.sy0) as u
  from boxes b join structure s on b.page_ix = s.page_ix and b.x0 < s.sx1 and s.sx0 < b.x1 and b.y0 < s.sy1 and s.sy0 < b.y1
), best as (select page_ix, box_id, item_id, kind, i / (u - i) as v from m where i / (u - i) >= 0.6 qualify row_number() over (partition by page_ix, box_id order by i / (u - i) desc, item_id) = 1)"""


@query(f"with {v.BOXES}, {v.STRUCTURE}, {_BEST} select b.page_ix, b.box_id, item_id, round(v, 6) as match_iou from boxes b left join best using (page_ix, box_id)")
def best_metadata_match(spark, d):
    return spatial.best_match(v.boxes(spark, d), v.structure(spark, d)).select("page_ix", "box_id", "item_id", F.round("match_iou", 6).alias("match_iou"))


@query(f"with {v.BOXES}, {v.STRUCTURE}, {_BEST} select b.page_ix, b.box_id from boxes b left join best using (page_ix, box_id) where coalesce(kind, '') not in ('column_header', 'row_header', 'section_header')")
def header_suppression(spark, d):
    return spatial.suppress_headers(v.boxes(spark, d), v.structure(spark, d)).select("page_ix", "box_id")


_TABLES = "tables as (select page_ix, 1 as table_id, 0.0 as tx0, 0.0 as ty0, 300.0 as tx1, 360.0 as ty1 from boxes group by 1 union all select page_ix, 2, 200.0, 100.0, 612.0, 792.0 from boxes group by 1 union all select page_ix, 3, 190.0, 0.0, 370.0, 730.0 from boxes group by 1)"


def _tables(spark, d) -> DataFrame:
    pages = v.boxes(spark, d).select("page_ix").distinct()
    rows = F.array(*[F.struct(F.lit(k).alias("table_id"), *[F.lit(float(x)).alias(n) for n, x in zip(("tx0", "ty0", "tx1", "ty1"), box, strict=True)]) for k, box in ((1, (0, 0, 300, 360)), (2, (200, 100, 612, 792)), (3, (190, 0, 370, 730)))])
    return pages.select("page_ix", F.explode(rows).alias("t")).select("page_ix", "t.*")


@query(f"""with {v.BOXES}, {v.STRUCTURE}, {_TABLES}, inside as (
  select b.page_ix, b.box_id, b.x0, b.y0, b.x1, b.y1, min(table_id) as table_id from boxes b join tables t on b.page_ix = t.page_ix and x0 >= tx0 - 2 and y0 >= ty0 - 2 and x1 <= tx1 + 2 and y1 <= ty1 + 2 group by all
), m as (
  select i.page_ix, i.box_id, i.table_id, s.item_id, (least(x1, sx1) - greatest(x0, sx0)) * (least(y1, sy1) - greatest(y0, sy0)) as i, (x1 - x0) * (y1 - y0) + (sx1 - sx0) * (sy1 - sy0) as u
  from inside i join structure s on i.page_ix = s.page_ix and i.table_id = s.item_id % 2 + 1 and x0 < sx1 and sx0 < x1 and y0 < sy1 and sy0 < y1
) select page_ix, table_id, box_id, item_id as cell_id, round(i / (u - i), 6) as iou from m where i / (u - i) > 0.5 qualify row_number() over (partition by page_ix, box_id order by i / (u - i) desc, item_id) = 1""")
def table_cell_membership(spark, d):
    cells = v.structure(spark, d).withColumn("table_id", (F.col("item_id") % 2 + 1).cast("int"))
    return spatial.table_membership(v.boxes(spark, d), _tables(spark, d), cells).withColumn("iou", F.round("iou", 6))


def _edge(name: str, column: str) -> None:
    sql = f"with {v.BOXES} select page_ix, cast(round_even({column}, 0) as double) as bucket, count(*) as n, round(avg({column}), 6) as value, min(box_id) as first_box from boxes group by 1, 2"

    def run(spark: SparkSession, d: str) -> DataFrame:
        b = v.boxes(spark, d)
        return b.groupBy("page_ix", F.bround(column).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(column), 6).alias("value"), F.min("box_id").alias("first_box"))

    run.__name__ = name
    query(sql)(run)


for _name, _column in (("left_edge_buckets", "x0"), ("right_edge_buckets", "x1"), ("top_edge_buckets", "y0"), ("row_edge_buckets", "y1")):
    _edge(_name, _column)


@query(f"""with {v.BOXES}, e as (select page_ix, unnest(['left', 'right', 'top', 'bottom']) as side, unnest([x0, x1, y0, y1]) as value from boxes),
c as (select page_ix, side, round_even(value, 0) as bucket, count(*) as n from e group by all)
select page_ix, side, bucket, n, rank from (select *, row_number() over (partition by page_ix, side order by n desc, bucket) as rank from c) where rank <= 20""")
def top_buckets_per_side(spark, d):
    """The 20 fullest one-point buckets of each side of each page."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("value")) for s, c in (("left", "x0"), ("right", "x1"), ("top", "y0"), ("bottom", "y1"))])).alias("e")
    c = v.boxes(spark, d).select("page_ix", sides).groupBy("page_ix", "e.side", F.bround("e.value").alias("bucket")).agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("page_ix", "side").orderBy(F.desc("n"), "bucket"))).filter("rank <= 20")


_ISLANDS = """i as (select *, cast(sum(case when gap > {eps} or gap is null then 1 else 0 end) over (partition by {keys} order by c, box_id) as bigint) as island from (
  select *, c - lag(c) over (partition by {keys} order by c, box_id) as gap from {source}))"""


@query(f"""with {v.BOXES}, b as (select *, (y0 + y1) / 2 as c from boxes), {_ISLANDS.format(eps=12, keys="page_ix", source="b")}
select page_ix, island, count(*) as n, min(c) as low, max(c) as high from i group by 1, 2 having count(*) >= 2""")
def islands_vertical(spark, d):
    b = v.boxes(spark, d).withColumn("c", (F.col("y0") + F.col("y1")) / 2)
    return lookups.islands(b, ["page_ix"], "c", 12.0).groupBy("page_ix", "island").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).filter("n >= 2")


@query(f"""with {v.BOXES}, b as (select *, (x0 + x1) / 2 as c from boxes), {_ISLANDS.format(eps=40, keys="page_ix, y0", source="b")}
select page_ix, y0, island, count(*) as n, min(c) as low, max(c) as high from i group by 1, 2, 3 having count(*) >= 2""")
def islands_horizontal_in_band(spark, d):
    b = v.boxes(spark, d).withColumn("c", (F.col("x0") + F.col("x1")) / 2)
    return lookups.islands(b, ["page_ix", "y0"], "c", 40.0).groupBy("page_ix", "y0", "island").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).filter("n >= 2")


@query(f"""with {v.BOXES}, b as (select *, (y0 + y1) / 2 as c from boxes), {_ISLANDS.format(eps=12, keys="page_ix", source="b")},
big as (select *, count(*) over (partition by page_ix, island) as size from i),
b2 as (select page_ix, island as band, box_id, (x0 + x1) / 2 as c, x0, y0, x1, y1 from big where size >= 2),
j as (select *, cast(sum(case when gap > 40 or gap is null then 1 else 0 end) over (partition by page_ix, band order by c, box_id) as bigint) as block from (select *, c - lag(c) over (partition by page_ix, band order by c, box_id) as gap from b2))
select page_ix, band, block, count(*) as cell_count, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from j group by 1, 2, 3 having count(*) >= 2""")
def two_stage_blocks(spark, d):
    """Bands of centres along y, then groups along x in each band."""
    b = lookups.islands(v.boxes(spark, d).withColumn("c", (F.col("y0") + F.col("y1")) / 2), ["page_ix"], "c", 12.0, out="band")
    size = F.count("*").over(Window.partitionBy("page_ix", "band"))
    b = b.withColumn("_n", size).filter("_n >= 2").withColumn("c", (F.col("x0") + F.col("x1")) / 2)
    j = lookups.islands(b, ["page_ix", "band"], "c", 40.0, out="block")
    return j.groupBy("page_ix", "band", "block").agg(F.count("*").alias("cell_count"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]).filter("cell_count >= 2")


@query()
def iterative_blocks(spark, d):
    """Alternating splits along y, x, y with the noise rules of kernels.split_iteratively."""
    return blocks.iterative(v.boxes(spark, d), ["page_ix"])


@query(f"""with {v.BOXES}, t as (select page_ix, y0, count(*) as cells, min(x0) as left_edge from boxes group by 1, 2)
select page_ix, y0, cells, y0 - lag(y0) over (partition by page_ix order by y0) as spacing from t""")
def line_spacing(spark, d):
    return lookups.line_spacing(v.boxes(spark, d), ["page_ix"])


@query(f"""with {v.BOXES}, t as (select distinct page_ix, y0 from boxes), s as (select page_ix, y0 - lag(y0) over (partition by page_ix order by y0) as g from t),
c as (select page_ix, round_even(g * 2, 0) / 2 as bucket, count(*) as n, avg(g) as mean from s where g is not null group by 1, 2)
select page_ix, bucket as spacing, n, round(mean, 6) as mean from c qualify row_number() over (partition by page_ix order by n desc, bucket) = 1""")
def spacing_mode(spark, d):
    return lookups.modal_spacing(v.boxes(spark, d), ["page_ix"]).withColumn("mean", F.round("mean", 6))


_NEAR = """g as (select page_ix, median(greatest(1e-12, x1 - x0)) as cw, median(greatest(1e-12, y1 - y0)) as ch, min(x0) as mx, min(y0) as my from boxes group by 1),
c as (select b.*, floor((x0 - mx) / cw) as cx0, floor((x1 - mx) / cw) as cx1, floor((y0 - my) / ch) as cy0, floor((y1 - my) / ch) as cy1 from boxes b join g using (page_ix)),
near as (select a.page_ix, a.box_id as a, b.box_id as b, greatest(0, b.y0 - a.y1, a.y0 - b.y1) as gap from c a join c b on a.page_ix = b.page_ix and a.box_id <> b.box_id
  and b.cx0 <= a.cx1 + 1 and b.cx1 >= a.cx0 - 1 and b.cy0 <= a.cy1 + 1 and b.cy1 >= a.cy0 - 1
  and least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 and least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.15 * least(a.x1 - a.x0, b.x1 - b.x0)),
typical as (select page_ix, median(gap) as spacing, count(*) as n from (select page_ix, a, min(gap) as gap from near where gap > 0 group by 1, 2) group by 1)"""


@query(f"with {v.BOXES}, {_NEAR} select page_ix, cast(spacing as double) as spacing, n from typical")
def typical_spacing(spark, d):
    return spatial.typical_spacing(v.boxes(spark, d))


@query(f"""with recursive {v.BOXES}, {_NEAR}, e as (select page_ix, a, b from near left join typical using (page_ix) where spacing is null or gap <= 1.25 * spacing),
  r as (select page_ix, box_id, box_id as seen from boxes union select r.page_ix, r.box_id, e.b from r join e on r.page_ix = e.page_ix and r.seen = e.a)
select page_ix, box_id, min(seen) as component from r group by 1, 2""")
def text_clusters(spark, d):
    """Connected components of boxes that line up and lie at most 1.25 times the page's typical spacing apart."""
    return spatial.clusters(v.boxes(spark, d))


@query()
def text_blocks(spark, d):
    """Blocks of vertical runs, split into columns, over the page's first baselines."""
    b = v.tall_boxes(spark, d)
    return blocks.identify(b, baselines.detect(b, ["page_ix"]), ["page_ix"])


_EDGES = """e as (select page_ix, unnest(['left', 'right', 'top', 'bottom']) as side, unnest([x0, x1, y0, y1]) as edge, unnest([y0, y0, x0, x0]) as lo, unnest([y1, y1, x1, x1]) as hi,
  unnest([(y0 + y1) / 2, (y0 + y1) / 2, (x0 + x1) / 2, (x0 + x1) / 2]) as centre from boxes),
k as (select page_ix, side, round_even(edge, 0) as bucket, count(*) as n, avg(edge) as value, sqrt(greatest(0, sum(centre * centre) / count(*) - (sum(centre) / count(*)) * (sum(centre) / count(*)))) as spread
  from e group by 1, 2, 3 having count(*) >= case when side in ('left', 'right') then 3 else 2 end),
mm as (select *, round_even(edge, 0) as bucket, case when lo <= max(hi) over (partition by page_ix, side, round_even(edge, 0) order by lo, hi rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from e),
uu as (select *, sum(new) over (partition by page_ix, side, bucket order by lo, hi rows between unbounded preceding and current row) as run from mm),
cv as (select page_ix, side, bucket, sum(len) as covered from (select page_ix, side, bucket, run, max(hi) - min(lo) as len from uu group by 1, 2, 3, 4) group by 1, 2, 3),
w as (select k.*, case when side in ('left', 'right') then 612 else 792 end as across, round(least(1.0, covered / case when side in ('left', 'right') then 792.0 else 612.0 end), 3) as coverage from k join cv using (page_ix, side, bucket)),
sc as (select *, round(greatest(0.0, 1 - spread / 50), 3) as consistency, case when side in ('left', 'right') then case when value < across * 0.25 then 'page_left' when value > across * 0.75 then 'page_right' else 'mid_page' end
  else case when value < across * 0.25 then 'page_top' when value > across * 0.75 then 'page_bottom' else 'mid_page' end end as page_position, least(abs(value), abs(across - value)) as proximity from w),
cf as (select *, cast(round(cast(0.4 * least(1.0, n / 10.0) + 0.3 * coverage + 0.2 * consistency + case when proximity <= 50 then 0.2 else 0 end as decimal(18, 9)), 3) as double) as confidence from sc)"""


def _clusters(spark, d) -> DataFrame:
    return baselines.clusters(v.boxes(spark, d), ["page_ix"])


@query(f"with {v.BOXES}, {_EDGES} select page_ix, side, bucket, n as count, round(value, 6) as value, coverage, page_position from sc")
def baseline_clusters(spark, d):
    """Edges that enough boxes share, with their mean, coverage and place on the page."""
    return _clusters(spark, d).select("page_ix", "side", "bucket", "count", F.round("value", 6).alias("value"), "coverage", "page_position")


@query()
def detect_baselines(spark, d):
    """Baselines of each page, seeded by the blocks over its first baselines."""
    b = v.tall_boxes(spark, d)
    seeds = blocks.identify(b, baselines.detect(b, ["page_ix"]), ["page_ix"])
    return baselines.detect(b, ["page_ix"], seeds).drop("s0", "s1", "s2")


@query()
def refined_baselines(spark, d):
    """Baselines scored, filtered and ordered by confidence."""
    return baselines.refine(baselines.detect(v.boxes(spark, d), ["page_ix"]), ["page_ix"]).drop("s0", "s1", "s2")


_COVER = "s as (select page_ix, round_even(x0, 0) as bucket, y0 as lo, y1 as hi, box_id from boxes)"


@query(f"""with {v.BOXES}, {_COVER}, m as (
  select *, case when lo <= max(hi) over (partition by page_ix, bucket order by lo, hi, box_id rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from s
), u as (select *, sum(new) over (partition by page_ix, bucket order by lo, hi, box_id) as run from m), c as (select page_ix, bucket, run, max(hi) - min(lo) as len from u group by 1, 2, 3)
select page_ix, bucket, cast(sum(len) as double) as covered, round(least(1.0, sum(len) / 720), 6) as coverage, count(*) as runs from c group by 1, 2""")
def baseline_coverage_union(spark, d):
    """Length of the union of the vertical spans of the boxes on a left edge, and its share of the page."""
    s = v.boxes(spark, d).select("page_ix", F.bround("x0").alias("bucket"), F.col("y0").alias("lo"), F.col("y1").alias("hi"))
    u = baselines.union_of_spans(s, ["page_ix", "bucket"])
    return u.withColumn("coverage", F.round(F.least(F.lit(1.0), F.col("covered") / 720), 6))


@query(f"with {v.BOXES}, {_EDGES} select page_ix, side, bucket, consistency from sc")
def baseline_consistency(spark, d):
    return _clusters(spark, d).select("page_ix", "side", "bucket", baselines.consistency().alias("consistency"))


@query(f"with {v.BOXES}, {_EDGES} select page_ix, side, bucket, n as count, round(proximity, 2) as edge_proximity, confidence from cf")
def baseline_confidence(spark, d):
    """Support, coverage, consistency and nearness to the page edge in one number (up to 1.1)."""
    return baselines.scored(_clusters(spark, d)).select("page_ix", "side", "bucket", "count", "edge_proximity", "confidence")


#: Limits at which each of the four reasons is met; the defaults turn nothing down.
_STRICT = baselines.Limits(min_confidence=0.3, min_support=3.0, mid_page_coverage=0.05, min_consistency=0.1)


@query(f"""with {v.BOXES}, {_EDGES}, r as (select *, list_filter([case when confidence < 0.3 then printf('low_confidence (%.3f < 0.3)', confidence) end, case when n < 3 then printf('low_support (%d < 3.0)', n) end,
  case when side in ('left', 'right') and page_position = 'mid_page' and coverage < 0.05 then printf('low_coverage_mid_page (%.3f < 0.05)', coverage) end,
  case when consistency < 0.1 then printf('low_consistency (%.3f < 0.1)', consistency) end], lambda x: x is not null) as reasons from cf)
select page_ix, side, bucket, confidence, len(reasons) = 0 as retained, array_to_string(reasons, ', ') as reasons from r""")
def baseline_filter_reasons(spark, d):
    j = baselines.judged(_clusters(spark, d), t=_STRICT)
    return j.select("page_ix", "side", "bucket", "confidence", "retained", F.array_join("reasons", ", ").alias("reasons"))


@query(f"""with {v.BOXES}, {_EDGES}, r as (select *, row_number() over (partition by page_ix order by confidence desc, n desc, side, bucket) as rank from cf where confidence >= 0.03 and n >= 1)
select page_ix, side, bucket, confidence, rank from r where rank <= 10""")
def top_baselines(spark, d):
    """The ten most certain edges of each page under the default limits."""
    j = baselines.judged(_clusters(spark, d)).filter("retained")
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("page_ix").orderBy(F.desc("confidence"), F.desc("count"), "side", "bucket"))).filter("rank <= 10").select("page_ix", "side", "bucket", "confidence", "rank")


@query(f"""with {v.BOXES}, {_EDGES}, ix as (select page_ix, box_id, unnest(['left', 'right', 'top', 'bottom']) as side, round_even(unnest([x0, x1, y0, y1]), 0) as bucket, unnest([y0, y0, x0, x0]) as lo from boxes),
top as (select * from ix qualify row_number() over (partition by page_ix, side, bucket order by lo, box_id) <= 3)
select sc.page_ix, sc.side, sc.bucket, n as count, string_agg(cast(box_id as varchar), ' ' order by lo, box_id) as samples from sc join top on top.page_ix = sc.page_ix and top.side = sc.side and top.bucket = sc.bucket group by all""")
def baseline_samples(spark, d):
    """The first three boxes on each edge that many boxes share."""
    s = baselines.clusters(v.boxes(spark, d), ["page_ix"], ident="box_id", keep=3)
    return s.select("page_ix", "side", "bucket", "count", F.array_join(F.transform("samples", lambda x: x.cast("string")), " ").alias("samples"))


@query()
def baseline_suppression(spark, d):
    """Horizontal baselines left after greedy suppression within five points."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        return p[kernels.suppress_near(p["value"].to_numpy(), p["n"].to_numpy())]

    b = v.boxes(spark, d).groupBy("page_ix", F.bround("y1").alias("bucket")).agg(F.count("*").alias("n"), F.avg("y1").alias("value")).filter("n >= 2")
    return kernels.per_page(b, ["page_ix"], kernel, "page_ix long, bucket double, n long, value double")


@query()
def baseline_chain_merge(spark, d):
    """Left and right baselines of a page, merged along their common list."""
    return baselines.detect(v.boxes(spark, d), ["page_ix"]).filter("side in ('left', 'right')").select("page_ix", "side", "value", "count", "coverage")


@query(f"with {v.BOXES} select page_ix, box_id, cast(dense_rank() over (partition by page_ix order by y0) - 1 as bigint) as line from boxes")
def fold_lines(spark, d):
    """Lines of a page by running mean of centres; rows of this layout lie 12 points apart, so each is a line."""
    return blocks.fold(v.boxes(spark, d), ["page_ix"])


@query(f"""with recursive {v.BOXES}, low as (select page_ix, box_id, (y0 / 12 * 0.7 + (y0 / 12 * 0.7 + 10)) / 2 as c from boxes), o as (select *, row_number() over (partition by page_ix order by c, box_id) as k from low),
t as (select page_ix, box_id, k, cast(0 as bigint) as line, c as s, cast(1 as bigint) as n from o where k = 1 union all select o.page_ix, o.box_id, o.k, case when o.c - s / n <= 1.5 then line else line + 1 end,
  case when o.c - s / n <= 1.5 then s + o.c else o.c end, case when o.c - s / n <= 1.5 then n + 1 else 1 end from t join o on o.page_ix = t.page_ix and o.k = t.k + 1)
select page_ix, box_id, line from t""")
def fold_drifting_lines(spark, d):
    """The same where rows lie 0.7 points apart, so that a line's mean drifts with what joins it."""
    y0 = F.col("y0") / 12 * 0.7
    return blocks.fold(v.boxes(spark, d).withColumns({"y0": y0, "y1": y0 + 10}), ["page_ix"])


@query(f"""with {v.BOXES}, {v.BASELINES}
select page_ix, box_id, bucket, round(dist, 6) as distance from (
  select b.page_ix, b.box_id, l.bucket, abs(b.x0 + 2 - l.value) as dist, row_number() over (partition by b.page_ix, b.box_id order by abs(b.x0 + 2 - l.value), l.bucket) as r
  from boxes b join baselines l on b.page_ix = l.page_ix and abs(b.x0 + 2 - l.value) <= 5) where r = 1""")
def nearest_baseline(spark, d):
    near = lookups.nearest_within(v.boxes(spark, d), v.baselines(spark, d), ["page_ix"], F.col("x0") + 2, 5.0, "bucket").filter("near is not null")
    return near.select("page_ix", "box_id", F.col("near.label").alias("bucket"), F.round("near.distance", 6).alias("distance"))


@query(f"""with {v.BOXES}, l as (select page_ix, round_even(y1, 0) as value, count(*) as n from boxes group by 1, 2 having count(*) >= 2)
select b.page_ix, b.box_id, min(l.value) as next_baseline from boxes b left join l on b.page_ix = l.page_ix and l.value >= b.y1 + 1 group by 1, 2""")
def next_baseline_asof(spark, d):
    """The first baseline strictly below a box, found by merging both into one ordered sequence per page."""
    b = v.boxes(spark, d)
    lines = b.groupBy("page_ix", F.bround("y1").alias("value")).agg(F.count("*").alias("n")).filter("n >= 2")
    return lookups.next_baseline(b, lines, ["page_ix"], F.col("y1") + 1).withColumnRenamed("next", "next_baseline")


@query(f"""with {v.BOXES}, {v.BASELINES}, o as (select page_ix, list(value order by n desc, bucket) as vs from baselines group by 1)
select b.page_ix, b.box_id, list_filter(vs, lambda x: abs(b.x0 + 2 - x) <= 5)[1] as baseline, coalesce(len(list_filter(vs, lambda x: abs(b.x1 - x) < 1.5)) > 0, false) as right_aligned from boxes b left join o on b.page_ix = o.page_ix""")
def baseline_first_within(spark, d):
    """The first baseline, in order of support, within five points; and whether the other edge meets any."""
    j = lookups.first_within(v.boxes(spark, d), v.baselines(spark, d), ["page_ix"], F.col("x0") + 2, 5.0, [-F.col("n"), F.col("bucket")])
    return j.select("page_ix", "box_id", F.col("first").alias("baseline"), F.coalesce(F.exists("lines", lambda x: F.abs(F.col("x1") - x) < 1.5), F.lit(False)).alias("right_aligned"))


@query(f"""with {v.BOXES}, s as (
  select *, case when x0 - max(x1) over (partition by page_ix, y1 order by x0, x1, box_id rows between unbounded preceding and 1 preceding) <= 14 then 0 else 1 end as new from boxes
), r as (select *, cast(sum(new) over (partition by page_ix, y1 order by x0, x1, box_id) as bigint) as segment from s)
select page_ix, y1, segment, count(*) as cells, string_agg(text, ' ' order by x0, x1, box_id) as text, min(x0) as x0, max(x1) as x1 from r group by 1, 2, 3
having length(replace(string_agg(text, ' ' order by x0, x1, box_id), ' ', '')) >= 5 and count(*) >= 2""")
def baseline_intrusion_segments(spark, d):
    """Runs of boxes on a baseline with gaps of 14 points at most, and at least five letters."""
    w = Window.partitionBy("page_ix", "y1").orderBy("x0", "x1", "box_id")
    gap = F.col("x0") - F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = v.boxes(spark, d).withColumn("_n", F.when(gap <= 14, 0).otherwise(1)).withColumn("segment", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "x1", "box_id", "text"))), lambda x: x["text"]), " ")
    r = s.groupBy("page_ix", "y1", "segment").agg(F.count("*").alias("cells"), text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return r.filter((F.length(F.replace("text", F.lit(" "), F.lit(""))) >= 5) & (F.col("cells") >= 2))


_BLOCKS = f"""blocks as (
  select page_ix, cast(floor(x0 / 100) as bigint) as block, count(*) as cells, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, mode_x as baseline,
    avg(case when abs(x0 - mode_x) <= 5 then 1.0 else 0.0 end) as aligned from (
    select *, first_value(m) over (partition by page_ix, floor(x0 / 100) order by n desc, m) as mode_x from (
      select *, round_even(x0, 0) as m, count(*) over (partition by page_ix, floor(x0 / 100), round_even(x0, 0)) as n from boxes)) group by page_ix, floor(x0 / 100), mode_x)"""


def columns(spark, d) -> DataFrame:
    """Columns 100 points wide as blocks, with their most frequent left edge and the share of boxes on it."""
    key = F.floor(F.col("x0") / 100).cast("long")
    b = v.boxes(spark, d).withColumn("block", key).withColumn("m", F.bround("x0"))
    n = F.count("*").over(Window.partitionBy("page_ix", "block", "m"))
    b = b.withColumn("n", n).withColumn("baseline", F.first("m").over(Window.partitionBy("page_ix", "block").orderBy(F.desc("n"), "m")))
    aligned = F.avg(F.when(F.abs(F.col("x0") - F.col("baseline")) <= 5, 1.0).otherwise(0.0))
    return b.groupBy("page_ix", "block", "baseline").agg(F.count("*").alias("cells"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), aligned.alias("aligned"))


_TYPED = """m as (select *, cast(floor(x0 / 100) as bigint) as block, round_even(x0, 0) as ml, round_even(x1, 0) as mr from boxes),
bl as (select page_ix, block, ml as lb from m group by 1, 2, 3 qualify row_number() over (partition by page_ix, block order by count(*) desc, ml) = 1), br as (select page_ix, block, mr as rb from m group by 1, 2, 3 qualify row_number() over (partition by page_ix, block order by count(*) desc, mr) = 1),
sh as (select page_ix, block, lb, rb, count(*) as cells, avg(case when abs(x0 - lb) <= 5 then 1.0 else 0.0 end) as ls, avg(case when abs(x1 - rb) <= 5 then 1.0 else 0.0 end) as rs, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1
  from m join bl using (page_ix, block) join br using (page_ix, block) group by 1, 2, 3, 4),
ty as (select *, case when rs >= 0.7 then 'right' when ls >= 0.7 then 'left' when ls < 0.3 and rs < 0.3 then 'center' else 'mixed' end as alignment from sh),
typed as (select *, case alignment when 'right' then rb when 'left' then lb end as baseline, round(case alignment when 'right' then rs when 'left' then ls else 0 end, 3) as share from ty)"""


def _typed(spark, d) -> DataFrame:
    """Columns 100 points wide as blocks, with the alignment of their boxes."""
    return alignment.block_alignment(v.boxes(spark, d).withColumn("block_id", F.floor(F.col("x0") / 100).cast("long")), ["page_ix"], "box_id")


@query(f"with {v.BOXES}, {_TYPED} select page_ix, block, cells, baseline, share as confidence, alignment from typed")
def alignment_type_by_block(spark, d):
    return _typed(spark, d).select("page_ix", F.col("block_id").alias("block"), "cells", "baseline", "confidence", "alignment")


@query(f"""with {v.BOXES}, {_BLOCKS} select b.page_ix, b.box_id, k.block, k.baseline as expected, b.x0 as actual, round(b.x0 - k.baseline, 2) as deviation
from boxes b join blocks k on b.page_ix = k.page_ix and floor(b.x0 / 100) = k.block where abs(b.x0 - k.baseline) > 5""")
def alignment_deviations(spark, d):
    j = v.boxes(spark, d).withColumn("block", F.floor(F.col("x0") / 100).cast("long")).select("page_ix", "block", "box_id", F.col("x0").alias("actual")).join(columns(spark, d).select("page_ix", "block", "baseline"), ["page_ix", "block"])
    return j.filter(F.abs(F.col("actual") - F.col("baseline")) > 5).select("page_ix", "box_id", "block", F.col("baseline").alias("expected"), "actual", F.round(F.col("actual") - F.col("baseline"), 2).alias("deviation"))


#: Orders as two columns of cells, one aligned left and one right; some cells are moved off their edge, on some pages most.
_LINED = """lined as (select cast(o_orderkey // 40 as bigint) as page_ix, o_orderkey as box_id, o_orderkey % 2 as col, o_orderpriority as text, x0, x0 + w as x1, cast(o_orderkey % 40 * 14 as double) as y0, cast(o_orderkey % 40 * 14 + 10 as double) as y1
  from (select *, case when o_orderkey % 2 = 0 then 40 + move else 300 - move - w end as x0 from (select *, cast(6 * length(o_orderpriority) as double) as w,
    cast(case when o_custkey % case when o_orderkey // 40 % 7 = 0 then 2 else 17 end = 0 then o_custkey % 5 * 4 else 0 end as double) as move from orders)))"""


def _lined(spark, d) -> DataFrame:
    o = v.table(spark, d, "orders")
    often = F.when(F.floor(F.col("o_orderkey") / 40) % 7 == 0, F.col("o_custkey") % 2).otherwise(F.col("o_custkey") % 17) == 0
    move, w = F.when(often, F.col("o_custkey") % 5 * 4).otherwise(0).cast("double"), (6 * F.length("o_orderpriority")).cast("double")
    x0 = F.when(F.col("o_orderkey") % 2 == 0, 40 + move).otherwise(300 - move - w)
    y0 = (F.col("o_orderkey") % 40 * 14).cast("double")
    return o.select(F.floor(F.col("o_orderkey") / 40).cast("long").alias("page_ix"), F.col("o_orderkey").alias("box_id"), (F.col("o_orderkey") % 2).alias("block_id"), F.col("o_orderpriority").alias("text"), x0.alias("x0"), (x0 + w).alias("x1"), y0.alias("y0"), (y0 + 10).alias("y1"))


_OFF = _TYPED.replace("cast(floor(x0 / 100) as bigint) as block", "col as block").replace("from boxes", "from lined") + """, off as (
  select l.page_ix, l.box_id, l.text, k.block, k.alignment, k.share, k.baseline, round(case k.alignment when 'left' then l.x0 else l.x1 end - k.baseline, 2) as deviation from lined l join typed k on l.page_ix = k.page_ix and l.col = k.block where k.alignment in ('left', 'right') and k.share >= 0.7),
dv as (select *, count(*) over (partition by page_ix, block) as n, max(abs(deviation)) over (partition by page_ix, block) as largest from off where abs(deviation) > 5)"""


@query(f"""with {_LINED}, {_OFF} select page_ix, block, box_id, text, alignment, baseline as expected, deviation, case when largest > 10 or (n >= 2 and share >= 0.9) then 'HIGH' when largest > 5 then 'MEDIUM' else 'LOW' end as severity from dv""")
def column_anomalies(spark, d):
    """Cells off the edge that most of their column shares, with the column's severity."""
    cells = _lined(spark, d)
    found = alignment.column_anomalies(cells, alignment.block_alignment(cells, ["page_ix"], "box_id"), ["page_ix"], "box_id")
    return found.withColumnRenamed("block_id", "block")


@query(f"""with {_LINED}, {_OFF} select page_ix, block, count(*) as n, max(largest) as largest, max(case when largest > 10 or (n >= 2 and share >= 0.9) then 'HIGH' when largest > 5 then 'MEDIUM' else 'LOW' end) as severity from dv group by 1, 2""")
def alignment_severity(spark, d):
    """The severity of each column that has cells off its edge."""
    return column_anomalies(spark, d).groupBy("page_ix", "block").agg(F.count("*").alias("n"), F.max(F.abs("deviation")).alias("largest"), F.first("severity").alias("severity"))


_IOU_BLOCKS = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_IOU_TABLE = """it as (select page_ix, block, table_id, greatest(0, least(x1, tx1) - greatest(x0, tx0)) * greatest(0, least(y1, ty1) - greatest(y0, ty0)) as i, (x1 - x0) * (y1 - y0) + (tx1 - tx0) * (ty1 - ty0) as u from typed join tables using (page_ix)),
of_table as (select page_ix, block, min(table_id) filter (round(i / (u - i), 3) >= 0.5) as table_id, bool_or(round(i / (u - i), 3) >= 0.7) as in_table from it group by 1, 2),
c as (select t.*, o.table_id, o.in_table, round(0.25 * least(1.0, cells / 20.0) + 0.25 * share + 0.15 * case when (x1 - x0) * (y1 - y0) > 0 then least(1.0, cells / ((x1 - x0) * (y1 - y0)) / 5e-4) else 0 end
  + 0.15 * case when y1 > y0 then least(1.0, cells / (y1 - y0) / 0.1) else 0 end + case when in_table then 0.2 else 0 end, 3) as confidence from typed t join of_table o using (page_ix, block))"""


def _certain(spark, d) -> DataFrame:
    c = blocks.with_tables(_typed(spark, d).withColumnsRenamed({"block_id": "block", "confidence": "share"}), _tables(spark, d), ["page_ix"])
    return c.withColumn("confidence", blocks.confidence(F.col("cells"), F.col("share"), F.col("in_table"), g.box()))


@query(f"with {v.BOXES}, {_TYPED}, {_TABLES}, {_IOU_TABLE} select page_ix, block, table_id, in_table from c")
def block_table_membership(spark, d):
    """The first table that a block covers, and whether it fits one closely."""
    return _certain(spark, d).select("page_ix", "block", "table_id", "in_table")


@query(f"with {v.BOXES}, {_TYPED}, {_TABLES}, {_IOU_TABLE} select page_ix, block, cells, confidence from c")
def block_confidence(spark, d):
    """Cells, alignment, density, cells by height and a table's support in one number."""
    return _certain(spark, d).select("page_ix", "block", "cells", "confidence")


_NEST = f"""(b.x1 - b.x0) * (b.y1 - b.y0) < (a.x1 - a.x0) * (a.y1 - a.y0) and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1
  and {_IOU_BLOCKS} >= 0.8 * (b.x1 - b.x0) * (b.y1 - b.y0) and (b.x1 - b.x0) * (b.y1 - b.y0) < 0.5 * (a.x1 - a.x0) * (a.y1 - a.y0) and a.confidence - b.confidence >= 0.2"""


@query(f"""with {v.BOXES}, {_TYPED}, {_TABLES}, {_IOU_TABLE}
select page_ix, block, confidence from c b where not exists (select 1 from c a where a.page_ix = b.page_ix and {_NEST})""")
def nested_block_removal(spark, d):
    c = _certain(spark, d).select("page_ix", "block", "confidence", "x0", "y0", "x1", "y1")
    o = c.select(F.col("page_ix").alias("_p"), F.col("confidence").alias("_c"), *[F.col(x).alias(f"{x}_o") for x in ("x0", "y0", "x1", "y1")])
    a, b = g.box(suffix="_o"), g.box()
    nested = (F.col("page_ix") == F.col("_p")) & g.meets(a, b) & (g.intersection(a, b) >= 0.8 * g.area(b)) & (g.area(b) < 0.5 * g.area(a)) & (F.col("_c") - F.col("confidence") >= 0.2)
    return c.join(o, nested, "left_anti").select("page_ix", "block", "confidence")


_BANDS = """bands as (select page_ix, cast(floor(y0 / 120) as bigint) || ':' || kind as block, count(*) as cells, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1
  from (select *, unnest([text, '*']) as kind from boxes) group by page_ix, floor(y0 / 120), kind), st as (select *, case when y1 > y0 then cells / (y1 - y0) else 0 end as strength from bands)"""


@query(f"""with {v.BOXES}, {_BANDS}
select page_ix, block, round(strength, 6) as strength from st b where b.strength >= 0.05 or not exists (select 1 from st a where a.page_ix = b.page_ix and a.strength >= 0.05
  and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1 and round({_IOU_BLOCKS} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_IOU_BLOCKS}), 3) > 0.3)""")
def weak_block_removal(spark, d):
    """Bands of a page, and in each the boxes of one text: the thin ones that lie over fuller ones go."""
    b = v.boxes(spark, d).withColumn("kind", F.explode(F.array("text", F.lit("*"))))
    bands = b.groupBy("page_ix", F.concat(F.floor(F.col("y0") / 120).cast("string"), F.lit(":"), "kind").alias("block")).agg(F.count("*").alias("cells"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    return blocks.drop_weak(bands, ["page_ix"], "block").select("page_ix", "block", F.round("strength", 6).alias("strength"))


def _amount_blocks(spark, d) -> DataFrame:
    cells = _column_of_amounts(spark, d)
    typed = alignment.block_alignment(alignment.assign_blocks(cells, ["page_ix"], "box_id"), ["page_ix"], "box_id")
    return typed.withColumnRenamed("confidence", "share")


def _amount_tables(found: DataFrame) -> DataFrame:
    pages = found.groupBy("page_ix").agg(F.max("y1").alias("ty1"))
    return pages.select("page_ix", F.lit(1).alias("table_id"), F.lit(440.0).alias("tx0"), F.lit(0.0).alias("ty0"), F.lit(520.0).alias("tx1"), "ty1")


@query()
def merged_blocks(spark, d):
    """Blocks of amounts merged with their neighbours."""

    names = ["x0", "y0", "x1", "y1", "cells", "parts"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, of = [], []
        for k, page in enumerate(batch.column("rows").to_pylist()):
            items = [{"bbox": (r["x0"], r["y0"], r["x1"], r["y1"]), "alignment": r["alignment"], "cells": r["cells"], "merged_from": [r["block_id"]]} for r in page]
            found = kernels.merge_adjacent(items)
            rows += [(*m["bbox"], m["cells"], len(m["merged_from"])) for m in found]
            of += [k] * len(found)
        columns = [pa.array([r[c] for r in rows], pa.int64() if c > 3 else pa.float64()) for c in range(len(names))]
        return pa.RecordBatch.from_arrays([batch.column("page_ix").take(pa.array(of, pa.int64())), *columns], ["page_ix", *names])

    b = _amount_blocks(spark, d).select("page_ix", "block_id", "x0", "y0", "x1", "y1", "alignment", "cells")
    return kernels.many_pages(kernels.packed_pages(b, ["page_ix"], "block_id"), kernel, "page_ix long, x0 double, y0 double, x1 double, y1 double, cells long, parts long")


@query()
def refine_text_blocks(spark, d):
    """Blocks of amounts scored, merged, freed of nested and weak ones, with counts by stage."""
    found = stored(_amount_blocks(spark, d), "amounts")  # read for the tables too
    r = blocks.refine(found, _amount_tables(found), ["page_ix"])
    return r.select("page_ix", "block_id", "x0", "y0", "x1", "y1", "cells", "alignment", "confidence", F.size("merged_from").cast("long").alias("parts"), *[F.col("stages")[k].alias(k) for k in blocks.STAGES])


@query(f"""with {v.BOXES} select page_ix, bucket, n, box_id from (select *, count(*) over (partition by page_ix, bucket) as n from (select page_ix, box_id, round_even(x1 * 0.67, 0) / 0.67 as bucket from boxes)) where n >= 2""")
def right_aligned_values(spark, d):
    return lookups.shared_right_edges(v.boxes(spark, d).select("page_ix", "box_id", "x1"), ["page_ix"]).drop("x1")


@query(f"with {v.BOXES} select distinct page_ix, round(x0, 3) as x0, round(y0, 3) as y0, round(x1, 3) as x1, round(y1, 3) as y1 from boxes")
def distinct_cells(spark, d):
    return v.boxes(spark, d).select("page_ix", *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")]).dropDuplicates()


@query(f"""with {v.BOXES}, {v.STRUCTURE}, hidden as (select page_ix, sx0, sy0, sx1, sy1 from structure where kind = 'column_header')
select page_ix, box_id from boxes b where not exists (select 1 from hidden h where h.page_ix = b.page_ix and x0 < sx1 and sx0 < x1 and y0 < sy1 and sy0 < y1
  and (least(x1, sx1) - greatest(x0, sx0)) * (least(y1, sy1) - greatest(y0, sy0)) > 0.05 * ((x1 - x0) * (y1 - y0) + (sx1 - sx0) * (sy1 - sy0) - (least(x1, sx1) - greatest(x0, sx0)) * (least(y1, sy1) - greatest(y0, sy0))))""")
def suppress_overlaps_with_hidden(spark, d):
    hidden = v.structure(spark, d).filter("kind = 'column_header'")
    return spatial.suppress_overlaps(v.boxes(spark, d), hidden).select("page_ix", "box_id")


_CLASSIFIED = """lv as (select page_ix, list(value) filter (side = 'left' and n >= 3) as ls, list(value) filter (side = 'right' and n >= 3) as rs from k group by 1),
near_edge as (select b.page_ix, b.box_id, b.x0, b.x1, list_min(list_transform(ls, lambda x: {'d': abs(b.x0 + 2 - x), 'v': x})) as l, list_min(list_transform(rs, lambda x: {'d': abs(b.x1 + 2 - x), 'v': x})) as r from boxes b left join lv on b.page_ix = lv.page_ix)"""


@query(f"""with {v.BOXES}, {_EDGES}, {_CLASSIFIED} select page_ix, box_id, case when l.d <= 3 then 'left' when r.d <= 3 then 'right' else 'center' end as orientation,
  round(case when l.d <= 3 then l.v when r.d <= 3 then r.v else (x0 + 2 + x1 + 2) / 2 end, 6) as baseline_value, round(case when l.d <= 3 then l.d when r.d <= 3 then r.d end, 6) as baseline_diff from near_edge""")
def cell_alignment(spark, d):
    """Boxes, moved by two points, by the nearest left edge of the page, else the nearest right one, else as centred."""
    moved = v.boxes(spark, d).withColumns({"x0": F.col("x0") + 2, "x1": F.col("x1") + 2})
    c = blocks.classify_cells(moved, _clusters(spark, d), ["page_ix"])
    return c.select("page_ix", "box_id", "orientation", F.round("baseline_value", 6).alias("baseline_value"), F.round("baseline_diff", 6).alias("baseline_diff"))


@query(f"""with {v.BOXES} select b.page_ix, b.box_id, min(c.box_id) as value_box from boxes b left join boxes c on b.page_ix = c.page_ix and c.box_id > b.box_id and abs(c.y0 - b.y0) <= 3 and c.x0 > b.x0 and c.x0 - b.x1 <= 75 group by 1, 2""")
def label_value_search(spark, d):
    """For each box the first later one in its row, to its right and at most 75 points away."""
    return lookups.value_of_label(v.boxes(spark, d), ["page_ix"]).withColumnRenamed("value", "value_box")


def _column_of_amounts(spark, d) -> DataFrame:
    """Amounts that end at 500 points, every eleventh customer's a little farther right."""
    f = v.forms(spark, d).join(v.table(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), "o_custkey"), "pair_id")
    x1 = F.when(F.col("o_custkey") % 11 == 0, 512.3).otherwise(500.0)
    y0 = (F.col("pair_id") % 40 * 11).cast("double")
    return f.select("page_ix", F.col("pair_id").alias("box_id"), F.col("value").alias("text"), (x1 - 6 * F.length("value")).alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 9).alias("y1"))


@query()
def block_alignment(spark, d):
    """Alignment of the blocks of iterative splitting."""
    blocked = alignment.assign_blocks(_column_of_amounts(spark, d), ["page_ix"], "box_id")
    return alignment.block_alignment(blocked, ["page_ix"], "box_id").select("page_ix", "block_id", "cells", "alignment", "baseline", "confidence")


@query()
def alignment_anomalies(spark, d):
    """The whole alignment pipeline over columns of amounts."""
    return alignment.anomalies(_column_of_amounts(spark, d), ["page_ix"], "box_id")


@query(f"""with {v.BOXES} select page_ix, cast(floor(x0 / 100) as bigint) as column_ix, count(*) as cells, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, left(string_agg(text, ' ' order by y0, box_id), 50) as text from boxes group by 1, 2""")
def table_columns(spark, d):
    """Columns of a page's grid as layout blocks: the union of their cells and the first 50 characters."""
    b = v.boxes(spark, d).withColumn("column_ix", F.floor(F.col("x0") / 100).cast("long"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "box_id", "text"))), lambda s: s["text"]), " ")
    return b.groupBy("page_ix", "column_ix").agg(F.count("*").alias("cells"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], F.left(text, F.lit(50)).alias("text"))


@query(f"""with {v.BOXES}, {v.STRUCTURE} select b.page_ix, b.box_id, count(*) as items from boxes b join structure s on b.page_ix = s.page_ix and b.y0 <= s.sy1 + 5 and s.sy0 <= b.y1 + 5 group by 1, 2""")
def vertical_overlap(spark, d):
    """How many structural items share a box's rows, give or take five points."""
    s = v.structure(spark, d).select(F.col("page_ix").alias("_p"), *[F.col(c) for c in ("sx0", "sy0", "sx1", "sy1")])
    j = v.boxes(spark, d).join(s, (F.col("page_ix") == F.col("_p")) & g.overlap_vertically(g.box(), [F.col(c) for c in ("sx0", "sy0", "sx1", "sy1")]))
    return j.groupBy("page_ix", "box_id").agg(F.count("*").alias("items"))


@query()
def dbscan_blocks(spark, d):
    """Blocks by density in the plane of (0.2 centre x, centre y); noise is left out."""
    from folioscan.operators import outliers

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        page, rows = kernels.rows_of(batch.column("rows"))
        box = np.stack([rows[c].to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "y0", "x1", "y1")], axis=1)
        label = outliers.dbscan_2d(((box[:, :2] + box[:, 2:]) / 2) * [0.2, 1.0], group=page)
        order = np.argsort(label, kind="stable")
        order = order[label[order] >= 0]
        first = np.flatnonzero(np.diff(label[order], prepend=-1))
        found, begins = label[order][first], np.searchsorted(page, np.arange(batch.num_rows))
        ends = [np.minimum.reduceat(box[order, :2], first), np.maximum.reduceat(box[order, 2:], first)] if len(first) else [box[:0, :2], box[:0, 2:]]
        columns = [found - begins[page[found]], np.diff(np.append(first, len(order))), *np.concatenate(ends, axis=1).T]
        return pa.RecordBatch.from_arrays([batch.column("page_ix").take(pa.array(page[found])), *map(pa.array, columns)], ["page_ix", "block_id", "cell_count", "x0", "y0", "x1", "y1"])

    b = v.boxes(spark, d).select("page_ix", "box_id", "x0", "y0", "x1", "y1")
    return kernels.many_pages(kernels.packed_pages(b, ["page_ix"], "box_id"), kernel, "page_ix long, block_id long, cell_count long, x0 double, y0 double, x1 double, y1 double")
