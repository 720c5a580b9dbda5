"""Queries over words, forms and properties: recognition, pairs, matching of renderings, profiles, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as tx
from folioscan.operators import elements, kernels, matching, profile
from folioscan.plans import views as v
from folioscan.plans.registry import query

_VALUES = """vals as (
  select 'o' || o_orderkey as id, case o_orderkey % 8 when 0 then printf('%.2f', o_totalprice) when 1 then strftime(o_orderdate, '%Y/%m/%d') when 2 then o_orderpriority when 3 then 'R ' || printf('%.2f', o_totalprice)
    when 4 then cast(o_orderkey as varchar) || '00' when 5 then 'AB' || o_custkey when 6 then 'Total: 12:30' else strftime(o_orderdate, '%d-%m-%Y') end as text from orders
  union all select 'c' || c_custkey, case c_custkey % 5 when 0 then 'http://x.org/a' when 1 then 'Closing Balance' when 2 then 'Total amount due' when 3 then printf('%.2f', c_acctbal) || ' Cr' else c_name end from customer)"""


def _values(spark, d) -> DataFrame:
    o, c = v.table(spark, d, "orders"), v.table(spark, d, "customer")
    money = F.format_string("%.2f", "o_totalprice")
    k = F.col("o_orderkey") % 8
    text = (
        F.when(k == 0, money).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k == 2, F.col("o_orderpriority")).when(k == 3, F.concat(F.lit("R "), money))
        .when(k == 4, F.concat(F.col("o_orderkey").cast("string"), F.lit("00"))).when(k == 5, F.concat(F.lit("AB"), "o_custkey")).when(k == 6, "Total: 12:30").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    )
    k = F.col("c_custkey") % 5
    other = F.when(k == 0, "http://x.org/a").when(k == 1, "Closing Balance").when(k == 2, "Total amount due").when(k == 3, F.concat(F.format_string("%.2f", "c_acctbal"), F.lit(" Cr"))).otherwise(F.col("c_name"))
    return o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), text.alias("text")).unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), other.alias("text")))


def _any(patterns: list[str], column: str = "text") -> str:
    quoted = [p.replace("'", "''") for p in patterns]
    return "(" + " or ".join(f"regexp_matches({column}, '{p}')" for p in quoted) + ")"


_TYPE = f"""case when {_any(tx.CURRENCY, "trim(text)")} then 'currency' when {_any(tx.NUMBER, "trim(text)")} then case when {_any(tx.DATE, "trim(text)")} then 'date' else 'number' end
  when len(ws) between 2 and 5 and len(list_filter(ws, lambda w: regexp_matches(w, '^\\pL+$') and not regexp_matches(w, '^\\p{{Lu}}\\p{{Ll}}*$'))) = 0 and len(list_filter(ws, lambda w: regexp_matches(w, '^\\pL+$'))) >= len(ws) * 0.8 then 'name' else 'text' end"""


@query(f"with {_VALUES}, t as (select *, regexp_split_to_array(trim(text), '\\s+') as ws from vals), k as (select id, text, {_TYPE} as content_type from t) select *, cast(case content_type when 'currency' then 2.5 when 'number' then 2.0 when 'name' then 3.0 else 1.0 end as double) as suspicion from k")
def content_type(spark, d):
    t = _values(spark, d).withColumn("content_type", tx.content_type(F.col("text")))
    return t.select("id", "text", "content_type", tx.suspicion(F.col("content_type")).alias("suspicion"))


@query(f"with {_VALUES}, t as (select id, regexp_extract_all(lower(text), '[a-z]+') as ws from vals) select id, len(ws) > 0 and len(list_filter(ws, lambda w: w not in ({', '.join(repr(w) for w in tx.COMMON_WORDS)}))) = 0 as common from t")
def common_phrase(spark, d):
    return _values(spark, d).select("id", tx.is_common_phrase(F.col("text")).alias("common"))


@query(f"with {_VALUES} select id, regexp_matches(text, '{tx.NUMERIC_VALUE}') as is_numeric, {_any([tx.COLON_TIME, tx.COLON_URL, tx.COLON_RATIO])} as excluded_colon, {_any(tx.EXCLUDED_VALUE)} as excluded_value from vals")
def value_filters(spark, d):
    t = F.col("text")
    return _values(spark, d).select("id", tx.is_numeric_value(t).alias("is_numeric"), tx.is_excluded_colon(t).alias("excluded_colon"), tx.is_excluded_value(t).alias("excluded_value"))


@query(f"with {_VALUES} select id, trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) as normal, regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g') as slug, string_split('ABCDEF+' || text, '+')[-1] as family, contains(text, '+') as subset, left(text, 5) as head from vals")
def text_normal_forms(spark, d):
    t = F.col("text")
    return _values(spark, d).select("id", tx.normalize(t).alias("normal"), tx.slugify(t).alias("slug"), tx.font_family(F.concat(F.lit("ABCDEF+"), t)).alias("family"), tx.is_subset_font(t).alias("subset"), F.left(t, F.lit(5)).alias("head"))


_LEV = "case when greatest(length({a}), length({b})) = 0 then 1.0::double else 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::double end"


@query(f"""with p as (select a.p_partkey as pa, b.p_partkey as pb, a.p_name as na, b.p_name as nb, lower(a.p_name) as a, lower(b.p_name) as b from part a join part b on b.p_partkey = a.p_partkey + 1)
select pa, pb, levenshtein(na, nb) as distance, round({_LEV.format(a="na", b="nb")}, 6) as ratio,
  round(greatest({_LEV.format(a="a", b="b")}, list_max(list_transform(string_split(b, ' '), lambda w: {_LEV.format(a="a", b="w")}))), 6) as word_similarity,
  round(case when contains(a, b) or contains(b, a) then 1.0 else greatest({_LEV.format(a="a", b="b")}, list_max(list_transform(string_split(b, ' '), lambda w: {_LEV.format(a="a", b="w")}))) end, 6) as phrase_similarity from p""")
def levenshtein_ratio(spark, d):
    p = v.table(spark, d, "part")
    j = p.select(F.col("p_partkey").alias("pa"), F.col("p_name").alias("na")).join(p.select(F.col("p_partkey").alias("pb"), F.col("p_name").alias("nb")), F.col("pb") == F.col("pa") + 1)
    a, b = tx.normalize(F.col("na")), tx.normalize(F.col("nb"))
    return j.select("pa", "pb", F.levenshtein("na", "nb").alias("distance"), F.round(tx.levenshtein_ratio(F.col("na"), F.col("nb")), 6).alias("ratio"), F.round(tx.token_similarity(a, b, False), 6).alias("word_similarity"), F.round(tx.token_similarity(a, b, True), 6).alias("phrase_similarity"))


# --- label/value pairs -------------------------------------------------------------------------------------------------


@query(f"with {v.FORMS} select page_ix, pair_id, label, value, spacing, left(full_text, length(full_text) - length(value)) as prefix from (select *, label || ' ' || value as full_text from forms) where strpos(full_text, ':') > 0")
def colon_pairs(spark, d):
    """Labels and values of the form, split at the first colon of the joined text."""
    f = v.forms(spark, d).withColumn("full", F.concat_ws(" ", "label", "value"))
    at = F.instr("full", ":")
    label, value = F.expr("left(full, instr(full, ':'))"), F.trim(F.expr("substring(full, instr(full, ':') + 1)"))
    return f.filter(at > 0).select("page_ix", "pair_id", label.alias("label"), value.alias("value"), "spacing", F.expr("left(full, length(full) - length(value))").alias("prefix"))


_DOMINANT = """b as (select page_ix, round_even(spacing * 2, 0) / 2 as bucket, count(*) as n, avg(spacing) as mean from forms group by 1, 2),
dom as (select page_ix, bucket, n, mean from b where n >= 3 qualify row_number() over (partition by page_ix order by n desc, bucket) = 1)"""


@query(f"with {v.FORMS}, {_DOMINANT} select page_ix, bucket, n, round(mean, 6) as dominant_spacing from dom")
def colon_dominant_spacing(spark, d):
    return _dominant(spark, d).select("page_ix", "bucket", "n", F.round("mean", 6).alias("dominant_spacing"))


def _dominant(spark, d) -> DataFrame:
    b = v.forms(spark, d).groupBy("page_ix", (F.bround(F.col("spacing") * 2) / 2).alias("bucket")).agg(F.count("*").alias("n"), F.avg("spacing").alias("mean")).filter("n >= 3")
    return b.withColumn("_r", F.row_number().over(Window.partitionBy("page_ix").orderBy(F.desc("n"), "bucket"))).filter("_r = 1").drop("_r")


_RIGHT = "right_edges as (select page_ix, round_even(value_x1, 0) as edge, count(*) as n from forms group by 1, 2 having count(*) >= 3)"


@query(f"""with {v.FORMS}, {_DOMINANT}, {_RIGHT}, r as (select f.page_ix, f.pair_id, bool_or(abs(f.value_x1 - e.edge) <= 1.5) as aligned from forms f left join right_edges e on f.page_ix = e.page_ix group by 1, 2)
select f.page_ix, f.pair_id, f.spacing, case when dom.mean is null then 'unclassified' when abs(f.spacing - dom.mean) <= 2 then 'consistent' when coalesce(r.aligned, false) then 'right_aligned' else 'deviation' end as classification
from forms f left join dom using (page_ix) left join r on f.page_ix = r.page_ix and f.pair_id = r.pair_id""")
def colon_classification(spark, d):
    """Pairs whose spacing is the page's own, whose values meet a right edge, or that deviate."""
    f = v.forms(spark, d)
    edges = f.groupBy("page_ix", F.bround("value_x1").alias("edge")).agg(F.count("*").alias("n")).filter("n >= 3").groupBy("page_ix").agg(F.collect_list("edge").alias("edges"))
    j = f.join(_dominant(spark, d).select("page_ix", "mean"), "page_ix", "left").join(edges, "page_ix", "left")
    aligned = F.coalesce(F.exists("edges", lambda e: F.abs(F.col("value_x1") - e) <= 1.5), F.lit(False))
    kind = F.when(F.col("mean").isNull(), "unclassified").when(F.abs(F.col("spacing") - F.col("mean")) <= 2, "consistent").when(aligned, "right_aligned").otherwise("deviation")
    return j.select("page_ix", "pair_id", "spacing", kind.alias("classification"))


# --- two renderings of a document ----------------------------------------------------------------------------------------

_STATS = r"""n as (select doc_id, 'original' as variant, len(regexp_split_to_array(trim(text), '\s+')) as n from lines union all select doc_id, 'visible', len(regexp_split_to_array(trim(text), '\s+')) from visible where trim(text) <> ''),
stat as (select doc_id, variant, count(*) as cells, cast(sum(n) as bigint) as words, avg(n) as mean, avg(case when n = 1 then 1.0 else 0.0 end) as single, avg(n) <= 1.30 and avg(case when n = 1 then 1.0 else 0.0 end) >= 0.65 as word_level from n group by 1, 2)"""


@query(f"with {v.LINES}, {v.CELLS}, {v.VISIBLE}, {_STATS} select doc_id, variant, cells, words, round(mean, 6) as mean_words, round(single, 6) as single_share, word_level from stat")
def granularity_stats(spark, d):
    """Words per cell of a rendering in lines and of one in words."""
    both = [matching.granularity(r(spark, d)).withColumn("variant", F.lit(n)) for n, r in (("original", v.lines), ("visible", v.visible))]
    s = both[0].unionByName(both[1])
    return s.select("doc_id", "variant", "cells", "words", F.round("mean_words", 6).alias("mean_words"), F.round("single_share", 6).alias("single_share"), "word_level")


@query(f"""with {v.LINES}, {v.CELLS}, {v.VISIBLE}, {_STATS} select o.doc_id, round(v.cells / o.cells::double, 6) as cell_ratio, round(v.mean / o.mean, 6) as words_ratio, v.cells / o.cells::double >= 1.40 and v.mean / o.mean <= 0.75 as problem,
  case when o.word_level and v.word_level then 'word' else 'phrase' end as mode from stat o join stat v on o.doc_id = v.doc_id and o.variant = 'original' and v.variant = 'visible'""")
def segmentation_ratio(spark, d):
    """How finely the two renderings are cut, and the mode in which they are to be matched."""
    s = matching.segmentation(v.lines(spark, d), v.visible(spark, d))
    return s.select("doc_id", F.round("cell_ratio", 6).alias("cell_ratio"), F.round("words_ratio", 6).alias("words_ratio"), "problem", "mode")


@query(r"""with l as (select doc_id, len(regexp_split_to_array(trim(text), '\s+')) as n, line_no % 10 = 0 as ocr from (select doc_id, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as text from (select doc_id, string_split(text, chr(10)) as ls from documents)) where trim(text) <> '')
select doc_id, count(*) as cells, cast(sum(n) as bigint) as words, count(*) filter (n > 1) as multi_word_cells, count(*) filter (ocr) as ocr_cells, round(count(*) filter (n > 1) / count(*)::double, 6) as multi_word_share from l group by 1""")
def cell_summary(spark, d):
    """Cells, words, cells of several words, and cells read by OCR (every tenth line is taken for one)."""
    return matching.cell_summary(v.lines(spark, d).withColumn("from_ocr", F.col("line_no") % 10 == 0)).withColumn("multi_word_share", F.round("multi_word_share", 6))


#: The SQL engine counts edits in bytes, so there every letter outside ASCII of these texts becomes a control character of its own.
_FOLD = "translate(lower({}), 'äçèéêíñóöüß', " + " || ".join(f"chr({i})" for i in range(1, 12)) + ")"
_ROW = f"""fc as materialized (select *, cast(line_no as bigint) * 1000000 + w as cell_index, {_FOLD.format("text")} as a from cells), fv as materialized (select *, cast(line_no as bigint) * 1000000 + w as cell_index, {_FOLD.format("text")} as a from visible),
j as (select c.doc_id, c.page_ix, c.cell_index, v.cell_index as match, c.a, v.a as b, c.x0, c.x1, greatest(0, least(c.x1, v.x1) - greatest(c.x0, v.x0)) * greatest(0, least(c.y1, v.y1) - greatest(c.y0, v.y0)) as i, 10 * (c.x1 - c.x0 + v.x1 - v.x0) as u, c.line_no = v.line_no as same
  from (select *, unnest([line_no - 1, line_no, line_no + 1]) as near from fc) c join fv v on c.doc_id = v.doc_id and c.page_ix = v.page_ix and c.near = v.line_no and c.x0 < v.x1 and v.x0 < c.x1)"""
_SIM = _LEV.format(a="a", b="b")


def _cells(df: DataFrame) -> DataFrame:
    """Cells of a page numbered in the order of its lines."""
    return df.select("doc_id", "page_ix", (F.col("line_no").cast("long") * 1000000 + F.col("w")).alias("cell_index"), "text", "x0", "y0", "x1", "y1")


_SEEN = f"""seen as (select doc_id, page_ix, cell_index, min(match) as match, arg_min(case when sim >= 0.92 then 'primary_' else 'lenient_' end || case when iou >= 0.1 then 'iou' else 'overlap' end, match) as reason
  from (select *, {_SIM} as sim, i / (u - i) as iou from j) where sim >= 0.7 group by 1, 2, 3)"""


@query(f"with {v.CELLS}, {v.VISIBLE}, {_ROW}, {_SEEN} select * from seen")
def visible_semi_join(spark, d):
    """The first visible cell, in order, that is near a cell and reads like it."""
    return matching.seen(v.renderings(spark, d, "normal"), "word")


@query(f"with {v.CELLS}, {v.VISIBLE}, {_ROW}, {_SEEN} select doc_id, page_ix, cell_index, text from fc c where not exists (select 1 from seen s where s.doc_id = c.doc_id and s.page_ix = c.page_ix and s.cell_index = c.cell_index) and lower(trim(c.text)) not in ('', '<unknown>', 'unknown')")
def not_visible_anti_join(spark, d):
    return matching.lacking(v.renderings(spark, d, "normal", raw=True), "word")


@query(f"""with {v.CELLS}, {v.VISIBLE}, {_ROW}, best as (select doc_id, page_ix, cell_index, match, {_SIM} as sim, i / (u - i) as iou from j)
select doc_id, page_ix, cell_index, match, round(sim, 6) as similarity, round(iou, 6) as iou from best qualify row_number() over (partition by doc_id, page_ix, cell_index order by round(sim, 9) desc, round(iou, 9) desc, match) = 1""")
def closest_visible(spark, d):
    """Of the visible cells near a cell the one that reads most like it."""
    c = matching.nearest(v.renderings(spark, d, "normal"), "word")
    return c.select("doc_id", "page_ix", "cell_index", "match", F.round("similarity", 6).alias("similarity"), F.round("iou", 6).alias("iou"))


_METHOD = "case when sim >= 0.85 and iou >= 0.3 then 'text_based' when iou >= 0.7 and sim >= 0.75 then 'spatial_based' when iou >= 0.9 then 'combined' end"
_MATCHED = f"m as (select doc_id, page_ix, cell_index as cell, match as span, sim, iou, {_METHOD} as match_method from (select *, {_SIM} as sim, i / (u - i) as iou from j where same))"


def _candidates(spark, d) -> DataFrame:
    return matching.pairs(v.renderings(spark, d, "lower"))


@query(f"with {v.CELLS}, {v.VISIBLE}, {_ROW}, {_MATCHED} select doc_id, page_ix, cell, span, round(0.6 * sim + 0.4 * iou, 6) as score, match_method from m where match_method is not null")
def match_candidates(spark, d):
    return _candidates(spark, d).select("doc_id", "page_ix", "cell", "span", F.round("score", 6).alias("score"), "match_method")


_GREEDY = f"""{v.CELLS}, {v.VISIBLE}, {_ROW}, {_MATCHED}, cand as materialized (select doc_id, page_ix, cell, span, match_method, 0.6 * sim + 0.4 * iou as score, dense_rank() over (partition by doc_id, page_ix order by cell) as k from m where match_method is not null),
pg as materialized (select doc_id, page_ix, max(k) as most from cand group by 1, 2), turns as (
  select doc_id, page_ix, cast(0 as bigint) as k, most, cast([] as bigint[]) as taken, cast(null as bigint) as cell, cast(null as bigint) as span from pg
  union all select t.doc_id, t.page_ix, t.k + 1, t.most, case when w.span is null then t.taken else list_append(t.taken, w.span) end, w.cell, w.span from turns t left join lateral (
    select arg_max(c.cell, (c.score, -c.span)) as cell, arg_max(c.span, (c.score, -c.span)) as span from cand c where c.doc_id = t.doc_id and c.page_ix = t.page_ix and c.k = t.k + 1 and not list_contains(t.taken, c.span)) w on true where t.k < t.most),
won as (select t.doc_id, t.page_ix, t.cell, t.span, c.score, c.match_method from turns t join cand c on c.doc_id = t.doc_id and c.page_ix = t.page_ix and c.cell = t.cell and c.span = t.span)"""


@query(f"with recursive {_GREEDY} select doc_id, page_ix, cell, span, round(score, 6) as score from won")
def greedy_match(spark, d):
    """One-to-one assignment per page, in order of cells."""
    return matching.matched(v.renderings(spark, d, "lower")).select("doc_id", "page_ix", "cell", "span", F.round("score", 6).alias("score"))


@query(f"""with recursive {_GREEDY}, sides as (select c.doc_id, w.match_method, 'cell' as side, w.span is not null as met from fc c left join won w on w.doc_id = c.doc_id and w.page_ix = c.page_ix and w.cell = c.cell_index
  union all select s.doc_id, null, 'span', w.cell is not null from fv s left join won w on w.doc_id = s.doc_id and w.page_ix = s.page_ix and w.span = s.cell_index),
n as (select doc_id, count(*) filter (side = 'cell') as total_cells, count(*) filter (side = 'span') as total_spans, count(*) filter (side = 'cell' and met) as matched, count(*) filter (side = 'cell' and not met) as unmatched_cells,
  count(*) filter (side = 'span' and not met) as unmatched_spans, count(*) filter (match_method = 'text_based') as text_based, count(*) filter (match_method = 'spatial_based') as spatial_based, count(*) filter (match_method = 'combined') as combined from sides group by 1)
select *, round(coalesce(100.0 * matched / nullif(total_cells, 0), 0), 6) as cell_match_rate, round(coalesce(100.0 * matched / nullif(total_spans, 0), 0), 6) as span_match_rate from n""")
def match_outcome(spark, d):
    """Cells and spans of each document with and without a partner."""
    s = matching.outcome_of(v.renderings(spark, d, "lower"))
    return s.withColumn("cell_match_rate", F.round("cell_match_rate", 6)).withColumn("span_match_rate", F.round("span_match_rate", 6))


@query(f"""with {v.CELLS}, {v.VISIBLE}, {_ROW}, {_MATCHED}, per as (select doc_id, count(*) filter (match_method = 'text_based') as text_based, count(*) filter (match_method = 'spatial_based') as spatial_based,
  count(*) filter (match_method = 'combined') as combined, count(distinct cell) filter (match_method is not null) as matched from m group by 1), t as (select doc_id, count(*) as cells from cells group by 1)
select t.doc_id, cells, coalesce(text_based, 0) as text_based, coalesce(spatial_based, 0) as spatial_based, coalesce(combined, 0) as combined, coalesce(matched, 0) as matched, round(100.0 * coalesce(matched, 0) / cells, 6) as match_rate from t left join per using (doc_id)""")
def match_statistics(spark, d):
    s = matching.statistics_of(v.renderings(spark, d, "lower"))
    return s.withColumn("match_rate", F.round("match_rate", 6))


_HIDDEN = f"""vis as (select * from boxes where box_id % 5 <> 0), seen as (select distinct b.page_ix, b.box_id from boxes b join vis o on b.page_ix = o.page_ix and b.text = o.text and b.x0 < o.x1 and o.x0 < b.x1 and greatest(0, o.y0 - b.y1, b.y0 - o.y1) <= 0.5 * (b.y1 - b.y0)),
gone as (select page_ix, box_id, text from boxes b where not exists (select 1 from seen s where s.page_ix = b.page_ix and s.box_id = b.box_id)),
p as (select a.page_ix, a.box_id as a, b.box_id as b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) as i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as u
  from boxes a join boxes b on a.page_ix = b.page_ix and a.box_id < b.box_id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1),
x as (select p.page_ix, case when sa.box_id is null then a else b end as box_id from p left join seen sa on sa.page_ix = p.page_ix and sa.box_id = a left join seen sb on sb.page_ix = p.page_ix and sb.box_id = b where i / (u - i) >= 0.1 and (sa.box_id is null) <> (sb.box_id is null))"""


@query(f"with {v.BOXES}, {_HIDDEN} select g.page_ix, g.box_id, g.text, case when exists (select 1 from x where x.page_ix = g.page_ix and x.box_id = g.box_id) then 'overlap' else 'missing' end as kind from gone g")
def hidden_overlap_xor(spark, d):
    """Boxes that another rendering (without every fifth box) lacks: under a box that it has, or by themselves."""
    b = v.boxes(spark, d)
    return matching.hidden_text(b, b.filter("box_id % 5 <> 0"), mode="word", keys=("page_ix",), ident="box_id")


# --- profiles and reports ------------------------------------------------------------------------------------------------

_PROPS = """props as (
  select cast(l_orderkey // 2000 as bigint) as doc, cast(l_orderkey // 200 as bigint) as page, unnest(['flag', 'status', 'quantity', 'tax']) as prop, unnest([l_returnflag, l_linestatus, cast(cast(l_quantity as integer) as varchar), cast(cast(round(l_tax * 100) as integer) as varchar)]) as value from lineitem)"""


def _histogram(spark, d) -> DataFrame:
    """The profile of four columns of the line items; the quantity stands for a size."""
    t = v.table(spark, d, "lineitem")
    rows = t.select(
        F.floor(F.col("l_orderkey") / 2000).cast("long").alias("doc"), F.floor(F.col("l_orderkey") / 200).cast("long").alias("page"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("l_quantity").cast("int").cast("string").alias("quantity"), F.round(F.col("l_tax") * 100).cast("int").cast("string").alias("tax"),
    )
    return profile.histogram(rows, {n: (profile.some, n) for n in ("flag", "status", "quantity", "tax")}, ("doc",), "page")


@query(f"with {_PROPS} select doc, prop, value, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by doc, prop), 6) as pct, row_number() over (partition by doc, prop order by count(*) desc, value) as rank from props group by doc, prop, value")
def value_histogram(spark, d):
    """All properties in one unpivoted aggregation, with shares and ranks."""
    return _histogram(spark, d).select("doc", "prop", "value", "n", F.round("pct", 6).alias("pct"), "rank")


@query(f"""with {_PROPS}, c as (select doc, prop, value, count(*) as n, 100.0 * count(*) / sum(count(*)) over (partition by doc, prop) as pct from props group by 1, 2, 3),
pg as (select doc, prop, value, min(n) as least_page from (select doc, page, prop, value, count(*) as n from props group by 1, 2, 3, 4) group by 1, 2, 3)
select doc, prop, value, n, round(pct, 6) as pct from c join pg using (doc, prop, value) where n < 4 or pct < 2.0 or (prop in ('quantity') and least_page <= 5)""")
def rare_values(spark, d):
    """Values met fewer than 4 times, in under 2 percent, or (sizes) at most 5 times on some page."""
    return _histogram(spark, d).filter(profile.is_rare(("quantity",))).select("doc", "prop", "value", "n", F.round("pct", 6).alias("pct"))


@query(f"with {_PROPS}, c as (select doc, prop, value, count(*) as n, sum(count(*)) over (partition by doc, prop) as total from props group by 1, 2, 3) select doc, prop, value, n from c where n < greatest(5, 0.05 * total)")
def uncommon_values(spark, d):
    return profile.uncommon(_histogram(spark, d)).select("doc", "prop", "value", "n")


@query(f"""with {v.BOXES}, z as (select *, x0 = 0 and box_id % 3 = 0 as blank, x0 = 0 and y0 = 0 as zero from boxes)
select page_ix, count(*) filter (blank) as blank, count(*) filter (blank and zero) as blank_zero, count(*) filter (blank and not zero) as blank_placed, coalesce(list(box_id order by box_id) filter (blank)[1:10], []) as examples from z group by 1""".replace("coalesce(list(box_id order by box_id) filter (blank)[1:10], [])", "array_to_string((list(box_id order by box_id) filter (blank))[1:10], ',')"))
def blank_census(spark, d):
    blank, zero = (F.col("x0") == 0) & (F.col("box_id") % 3 == 0), (F.col("x0") == 0) & (F.col("y0") == 0)
    ids = F.slice(F.sort_array(F.collect_list(F.when(blank, F.col("box_id")))), 1, 10)
    listed = F.when(F.count_if(blank) > 0, F.array_join(ids, ","))
    return v.boxes(spark, d).groupBy("page_ix").agg(F.count_if(blank).alias("blank"), F.count_if(blank & zero).alias("blank_zero"), F.count_if(blank & ~zero).alias("blank_placed"), listed.alias("examples"))


_REASONS = f"""reasons as (
  select page_ix, box_id, text, 'wide' as reason from boxes where x1 - x0 > 60 union all select page_ix, box_id, text, 'page edge' from boxes where x0 < 50
  union all select page_ix, box_id, text, 'top' from boxes where y0 < 60 union all select page_ix, box_id, text, 'bottom' from boxes where y1 > 700
  union all select page_ix, box_id, text, 'text NF' from boxes where text = 'NF' union all select page_ix, box_id, text, 'narrow' from boxes where x1 - x0 < 24)"""


_SOURCES = (("x1 - x0 > 60", "wide"), ("x0 < 50", "page edge"), ("y0 < 60", "top"), ("y1 > 700", "bottom"), ("text = 'NF'", "text NF"), ("x1 - x0 < 24", "narrow"))


def _reasons() -> Column:
    """What the sources find in a box, of which each page has one under its number: a box needs no other row for it."""
    return F.array_compact(F.array(*[F.when(F.expr(c), r) for c, r in _SOURCES]))


@query(f"with {v.BOXES}, {_REASONS} select page_ix, box_id, text, string_agg(reason, '; ' order by reason) as reasons, count(*) as n from reasons group by 1, 2, 3")
def annotation_reasons(spark, d):
    """Findings of several detectors united and gathered per box."""
    b = v.boxes(spark, d).select("page_ix", "box_id", "text", F.sort_array(_reasons()).alias("reasons")).filter(F.size("reasons") > 0)
    return b.select("page_ix", "box_id", "text", F.array_join("reasons", "; ").alias("reasons"), F.size("reasons").cast("long").alias("n"))


@query(f"with {v.BOXES}, {_REASONS} select reason, count(*) as n, count(distinct page_ix) as pages from reasons where not exists (select 1 from boxes b where b.page_ix = reasons.page_ix and b.box_id = reasons.box_id and b.text = 'NO') group by 1")
def severity_histogram(spark, d):
    """How many boxes and pages each reason is found on; a box whose own page has it under the text NO takes no part."""
    b = v.boxes(spark, d).filter("page_ix is null or not text <=> 'NO'").select("page_ix", F.explode(_reasons()).alias("reason"))
    by_page = b.groupBy("page_ix", "reason").agg(F.count("*").alias("n"))
    return by_page.groupBy("reason").agg(F.sum("n").alias("n"), F.count("page_ix").alias("pages"))


@query("""select lang, count(*) as documents, count(*) filter (trim(text) <> '') as with_text, cast(sum(n_chars) as bigint) as chars, count(*) filter (n_chars < 200) as short, left(min(text), 200) as preview,
  array_to_string(list_filter([case when count(*) filter (n_chars < 200) > 0 then 'has short texts' end, case when max(n_chars) > 20000 then 'has long texts' end], lambda x: x is not null), '; ') as note from documents group by 1""")
def document_summary(spark, d):
    short = F.count_if(F.col("n_chars") < 200)
    note = F.concat_ws("; ", F.array_compact(F.array(F.when(short > 0, "has short texts"), F.when(F.max("n_chars") > 20000, "has long texts"))))
    return v.table(spark, d, "documents").groupBy("lang").agg(
        F.count("*").alias("documents"), F.count_if(F.trim("text") != "").alias("with_text"), F.sum("n_chars").alias("chars"), short.alias("short"), F.left(F.min("text"), F.lit(200)).alias("preview"), note.alias("note")
    )


@query("select user_id as doc, max(event_id) filter (event_type = 'click') as latest, arg_max(value, event_id) as value, cast(json_extract_string(arg_max(props, event_id), '$.k') as integer) as k, count(*) as versions from events group by 1")
def latest_version_scan(spark, d):
    """The newest of a document's payloads, picked by its name, with a field out of its JSON."""
    e = v.table(spark, d, "events").groupBy(F.col("user_id").alias("doc")).agg(F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("latest"), F.max_by("value", "event_id").alias("value"), F.max_by("props", "event_id").alias("p"), F.count("*").alias("versions"))
    return e.select("doc", "latest", "value", F.from_json("p", "k int")["k"].alias("k"), "versions")


_SPANS = """sp as (select l_orderkey // 200 as doc_id, cast(l_orderkey // 20 as bigint) as page_ix, row_number() over (partition by l_orderkey // 20 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as span_index, 'ABCDEF+' || s_name as font from lineitem join supplier on l_suppkey = s_suppkey),
ev as (select page_ix, row_number() over (partition by page_ix order by o_orderkey) - 1 as k, o_orderstatus = 'F' and o_custkey % 3 = 0 as clip from (select cast(o_orderkey // 20 as bigint) as page_ix, * from orders)),
n as (select page_ix, count(*) as s from sp group by 1), e as (select page_ix, count(*) as e from ev group by 1)"""


def _spans(spark, d) -> DataFrame:
    order = Window.partitionBy("page_ix").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    t = v.table(spark, d, "lineitem").join(v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey").withColumn("page_ix", F.floor(F.col("l_orderkey") / 20).cast("long"))
    return t.select(F.floor(F.col("l_orderkey") / 200).cast("long").alias("doc_id"), "page_ix", F.row_number().over(order).cast("long").alias("span_index"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.concat(F.lit("ABCDEF+"), "s_name").alias("font"), F.col("l_quantity").alias("size"), F.lit(12.0).alias("line_height"), *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])


def _fonts(spark, d) -> DataFrame:
    """Every supplier as a font of all documents; the name is the part before the last figure, so some hold others."""
    return v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("font_id"), F.expr("left(s_name, length(s_name) - s_suppkey % 2)").alias("name"), (F.col("s_nationkey") % 2 == 0).alias("embedded"), F.lit("WinAnsi").alias("encoding"), F.lit("TrueType").alias("font_type"))


def _clips(spark, d) -> DataFrame:
    o = v.table(spark, d, "orders")
    return o.select(F.floor(F.col("o_orderkey") / 200).cast("long").alias("doc_id"), F.floor(F.col("o_orderkey") / 20).cast("long").alias("page_ix"), F.col("o_orderkey").alias("event_id"), F.lit("x").alias("text"), ((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 3 == 0)).alias("has_clip"))


@query(f"""with {_SPANS}, f as (select s_suppkey as font_id, left(s_name, length(s_name) - s_suppkey % 2) as name from supplier), names as (select distinct font from sp),
m as (select font, min(font_id) as font_id from names join f on contains(name, font) or contains(font, name) group by 1) select page_ix, span_index, m.font_id, f.name as font_name from sp left join m using (font) left join f on f.font_id = m.font_id""")
def span_fonts(spark, d):
    """Spans with the first font whose name holds theirs or is held by it."""
    return elements.font_of(_spans(spark, d), _fonts(spark, d), ()).select("page_ix", "span_index", "font_id", "font_name")


@query(f"""with {_SPANS}, b as (select sp.page_ix, span_index, cast(round_even((span_index - 1) * e / s::double, 0) as bigint) as lo, cast(round_even(span_index * e / s::double, 0) as bigint) as hi from sp join n using (page_ix) left join e using (page_ix))
select b.page_ix, b.span_index, coalesce(bool_or(clip), false) as has_clip from b left join ev on ev.page_ix = b.page_ix and ev.k >= lo and ev.k < greatest(hi, lo + 1) group by 1, 2""")
def span_clips(spark, d):
    """Spans with the clip flags of their share of the page's events united."""
    return elements.clip_of(_spans(spark, d), _clips(spark, d)).select("page_ix", "span_index", "has_clip")


@query(f"""with {_SPANS}, f as (select s_suppkey as font_id, left(s_name, length(s_name) - s_suppkey % 2) as name, s_nationkey % 2 = 0 as embedded from supplier), names as (select distinct font from sp),
m as (select font, min(font_id) as font_id from names join f on contains(name, font) or contains(font, name) group by 1),
b as (select sp.page_ix, span_index, font, cast(round_even((span_index - 1) * e / s::double, 0) as bigint) as lo, cast(round_even(span_index * e / s::double, 0) as bigint) as hi from sp join n using (page_ix) left join e using (page_ix)),
c as (select b.page_ix, b.span_index, any_value(b.font) as font, coalesce(bool_or(clip), false) as has_clip from b left join ev on ev.page_ix = b.page_ix and ev.k >= lo and ev.k < greatest(hi, lo + 1) group by 1, 2)
select c.page_ix, '//Document/P[' || c.page_ix || ']/StyleSpan' as path, coalesce(f.name, font) as font, string_split(coalesce(f.name, font), '+')[-1] as family, contains(coalesce(f.name, font), '+') as subset, f.embedded, has_clip, count(*) as spans from c left join m using (font) left join f on f.font_id = m.font_id group by all""")
def font_elements(spark, d):
    """Elements of a page, spans with fonts and clip flags, counted by what they have."""
    e = elements.assemble(_spans(spark, d), _fonts(spark, d), _clips(spark, d), ())
    return e.select("page_ix", "path", F.col("font.name").alias("font"), F.col("font.family_name").alias("family"), F.col("font.subset").alias("subset"), F.col("font.embedded").alias("embedded"), "has_clip").groupBy("page_ix", "path", "font", "family", "subset", "embedded", "has_clip").agg(F.count("*").alias("spans"))


@query()
def clip_walk(spark, d):
    """Painted text and whether it is clipped, from each page's stream of operators (events as operators)."""
    ops = {"click": "W", "view": "Tj", "purchase": "q", "error": "Q"}

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("event_id")
        shown = kernels.walk_clip([(ops.get(t, "Tj"), str(i)) for t, i in zip(p.event_type, p.event_id, strict=True)])
        return pd.DataFrame([(p.page.iloc[0], int(t), c) for t, c in shown], columns=["page", "event_id", "has_clip"])

    e = v.table(spark, d, "events").select((F.col("user_id") % 200).alias("page"), "event_id", "event_type")
    return kernels.per_page(e, ["page"], kernel, "page long, event_id long, has_clip boolean")


@query()
def hidden_text(spark, d):
    """Cells of one rendering that the other hides, with the kinds of matching.hidden_text."""
    return matching.hidden(v.renderings(spark, d, "normal", raw=True), "word")


@query("select cast(l_orderkey // 200 as bigint) as doc_id, count(*) as n_findings, count(distinct l_returnflag || l_linestatus) as kinds from lineitem where l_quantity > 45 group by 1")
def report_per_document(spark, d):
    """Findings gathered into one row per document."""
    from folioscan.operators import report

    t = v.table(spark, d, "lineitem").filter("l_quantity > 45").select(F.floor(F.col("l_orderkey") / 200).cast("long").alias("doc_id"), F.concat("l_returnflag", "l_linestatus").alias("kind"), F.col("l_partkey").alias("item"))
    return report.per_document(t).select("doc_id", "n_findings", F.size(F.array_distinct(F.transform("findings", lambda x: x["kind"]))).cast("long").alias("kinds"))


@query("""with f as (select cast(l_orderkey // 200 as bigint) as doc_id, 'item ' || l_partkey || ' ' || l_suppkey || ' ' || l_orderkey || ' ' || l_linenumber as text, case when l_quantity > 49 then 'HIGH' else 'LOW' end as severity from lineitem where l_quantity > 48),
r as (select *, count(*) over (partition by doc_id) as n, row_number() over (partition by doc_id order by case severity when 'HIGH' then 0 else 2 end, text) as k from f)
select doc_id, cast(k + 2 as integer) as line_no, '- [' || severity || '] ' || left(text, 60) as line from r where k <= 20
union all select doc_id, 1, '# Document ' || doc_id from r where k = 1 union all select doc_id, 2, n || ' findings' from r where k = 1""")
def report_markdown(spark, d):
    """Lines of a report: a heading, a count and the 20 gravest findings of each document."""
    from folioscan.operators import report

    t = v.table(spark, d, "lineitem").filter("l_quantity > 48")
    f = t.select(F.floor(F.col("l_orderkey") / 200).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("item"), "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber").alias("text"), F.when(F.col("l_quantity") > 49, "HIGH").otherwise("LOW").alias("severity"))
    return report.markdown(f)


@query("""with f as (select o_orderkey % 500 as doc_id, case when o_totalprice > 400000 then 'HIGH' when o_totalprice > 390000 then 'MEDIUM' else 'LOW' end as severity from orders where o_totalprice > 380000), p as (
  select doc_id, count(*) filter (severity = 'HIGH') as h, count(*) filter (severity = 'MEDIUM') as m, count(*) filter (severity = 'LOW') as l from f group by 1), dd as (select distinct o_orderkey % 500 as doc_id from orders)
select count(*) as documents, count(h) as with_findings, cast(coalesce(sum(h), 0) as bigint) as high, cast(coalesce(sum(m), 0) as bigint) as medium, cast(coalesce(sum(l), 0) as bigint) as low from dd left join p using (doc_id)""")
def report_summary(spark, d):
    from folioscan.operators import report

    o = v.table(spark, d, "orders").withColumn("doc_id", F.col("o_orderkey") % 500)
    severity = F.when(F.col("o_totalprice") > 400000, "HIGH").when(F.col("o_totalprice") > 390000, "MEDIUM").otherwise("LOW")
    return report.summary(o.filter("o_totalprice > 380000").select("doc_id", severity.alias("severity")), o.select("doc_id").distinct())


@query(f"with {v.FORMS} select page_ix, pair_id, label || value as text, strpos(label || value, ':') as colon from forms where strpos(label || value, ':') > 1 and value <> ''")
def inline_colon_pairs(spark, d):
    """Cells that hold a label and a value around a colon."""
    from folioscan.operators import pairs

    f = v.forms(spark, d).select("page_ix", "pair_id", F.concat("label", F.lit(" "), "value").alias("text"), F.lit(40.0).alias("x0"), F.col("value_x1").alias("x1"))
    p = pairs.inline_pairs(f)
    return p.select("page_ix", "pair_id", F.concat("label", F.lit(":"), "value").alias("text"), (F.length("label") + 1).alias("colon"))


@query(f"with {v.FORMS} select page_ix, pair_id, rtrim(label, ':') as label, value, value_x0 - label_x1 as spacing, value_x1 from forms")
def chained_colon_pairs(spark, d):
    """Labels and the cells after them, in payload order."""
    from folioscan.operators import pairs

    f = v.forms(spark, d)
    label = f.select("page_ix", (F.col("pair_id") * 2).alias("cell"), F.col("label").alias("text"), F.lit(40.0).alias("x0"), F.col("label_x1").alias("x1"), "y0")
    value = f.select("page_ix", (F.col("pair_id") * 2 + 1).alias("cell"), F.col("value").alias("text"), F.col("value_x0").alias("x0"), F.col("value_x1").alias("x1"), "y0")
    p = pairs.chained_pairs(label.unionByName(value), ["page_ix"], "cell")
    return p.select("page_ix", (F.col("cell") / 2).cast("long").alias("pair_id"), "label", "value", "spacing", "value_x1")


@query("""with recursive e as (select n_nationkey as id, case when n_nationkey >= 3 then n_nationkey // 3 end as parent, case when n_nationkey % 4 = 0 then n_regionkey end as page from nation),
t as (select id, parent, page, 0 as depth from e where parent is null union all select e.id, e.parent, coalesce(e.page, t.page), t.depth + 1 from e join t on e.parent = t.id) select * from t""")
def element_tree(spark, d):
    """Nested elements flattened, a page inherited from the parent."""
    from folioscan.sources import payload

    n = v.table(spark, d, "nation")
    parent = F.when(F.col("n_nationkey") >= 3, F.floor(F.col("n_nationkey") / 3).cast("int"))
    rows = n.select(F.lit("doc").alias("doc_id"), F.col("n_nationkey").alias("id"), parent.alias("parent"), F.when(F.col("n_nationkey") % 4 == 0, F.col("n_regionkey")).alias("page"))
    return payload.flatten_elements(rows).drop("doc_id")


@query(f"with {v.CELLS}, g as (select doc_id, line_no, w from cells where regexp_matches(text, '^[A-ZÄÉÈÖÜÓÍÑÊÇ]')) select doc_id, line_no, w from cells except select * from g")
def except_detected(spark, d):
    """Cells that an earlier detector (of capital letters) hasn't reported."""
    c = v.cells(spark, d).select("doc_id", "line_no", "w")
    known = v.cells(spark, d).filter(F.col("text").rlike("^[A-ZÄÉÈÖÜÓÍÑÊÇ]")).select("doc_id", "line_no", "w")
    return c.join(known.toDF("doc_id", "line_no", "w"), ["doc_id", "line_no", "w"], "left_anti").distinct()
