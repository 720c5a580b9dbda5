"""Queries over element files: nested elements, property profiles with their items, reports.

The files are line items as JSON, one file for 2,000 orders: pages hold orders, orders hold line items, and most name no
page of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators import profile, sections
from folioscan.plans import views as v
from folioscan.plans.registry import query
from folioscan.sources import payload

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def trees(spark, d) -> DataFrame:
    """(doc_id, tree): the JSON of each 2,000 orders."""
    read = ("l_orderkey", *_ORDER, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    # dealt by file while the rows are small: the three levels of lists need no other shuffle
    t = v.table(spark, d, "lineitem").select(*read, F.floor(F.col("l_orderkey") / 2000).cast("long").alias("doc")).repartition("doc").withColumn("page", F.floor(F.col("l_orderkey") / 20).cast("int"))
    k, text = F.col("l_suppkey"), F.concat("l_returnflag", "l_linestatus")
    font = F.struct(
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag") == "R").alias("embedded"), F.when(k % 3 == 0, "WinAnsi").when(k % 3 == 1, "").alias("encoding"), F.concat(F.lit("Fam"), (k % 4).cast("string")).alias("family_name"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("F"), (k % 7).cast("string"))).alias("name"), (F.col("l_linestatus") == "O").alias("monospaced"), F.when(F.col("l_quantity") > 25, True).alias("subset"),
    )
    height = F.col("l_quantity") + F.lit(0.5)
    line = F.struct(
        F.lit("//Document/P[1]/Span").alias("Path"), F.when(F.col("l_linenumber") == 5, F.col("page") + 1000).alias("Page"), text.alias("Text"), font.alias("Font"), (F.col("l_tax") > 0.05).alias("HasClip"),
        (F.col("l_quantity") + F.col("l_discount")).alias("TextSize"), F.when(F.col("l_linenumber") > 2, height).alias("LineHeight"),
        F.struct(F.when(F.col("l_linenumber") == 1, height).alias("LineHeight"), F.array(F.lit(1.0), F.lit(2.0), F.col("l_quantity"), F.lit(9.0)).alias("BBox")).alias("attributes"),
    )
    items = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["e"])
    orders = t.groupBy("doc", "page", "l_orderkey").agg(items(F.struct(*_ORDER, line.alias("e"))).alias("Kids"))
    order = F.struct(F.lit("//Document/P[1]").alias("Path"), F.col("l_orderkey").cast("string").alias("Text"), "Kids")
    pages = orders.groupBy("doc", "page").agg(items(F.struct("l_orderkey", order.alias("e"))).alias("Kids"))
    page = F.struct(F.lit("//Document").alias("Path"), F.col("page").alias("Page"), "Kids")
    whole = pages.groupBy("doc").agg(items(F.struct("page", page.alias("e"))).alias("elements"))
    return whole.select(F.col("doc").alias("doc_id"), F.parse_json(F.to_json(F.struct("elements"))).alias("tree"))


_NODES = """l as (select *, cast(l_orderkey // 2000 as bigint) as doc, cast(l_orderkey // 20 as integer) as page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as k from lineitem),
o as (select doc, page, l_orderkey, row_number() over (partition by doc, page order by l_orderkey) - 1 as j from (select distinct doc, page, l_orderkey from l)),
p as (select doc, page, row_number() over (partition by doc order by page) - 1 as i from (select distinct doc, page from l)),
e as (select doc, cast(i as varchar) as id, cast(null as varchar) as parent, page as own, cast(null as varchar) as text, '//Document' as path from p
  union all select o.doc, i || '.' || j, cast(i as varchar), null, cast(l_orderkey as varchar), '//Document/P[1]' from o join p on o.doc = p.doc and o.page = p.page
  union all select l.doc, i || '.' || j || '.' || k, i || '.' || j, case when l_linenumber = 5 then l.page + 1000 end, l_returnflag || l_linestatus, '//Document/P[1]/Span' from l join o on o.doc = l.doc and o.l_orderkey = l.l_orderkey join p on p.doc = l.doc and p.page = l.page)"""


@query(f"""with recursive {_NODES}, t as (select doc, id, parent, own as page_ix, 0 as depth, text, path from e where parent is null
  union all select e.doc, e.id, e.parent, coalesce(e.own, t.page_ix), t.depth + 1, e.text, e.path from e join t on e.doc = t.doc and e.parent = t.id)
select doc as doc_id, id, parent, page_ix, cast(depth as integer) as depth, text, case depth when 0 then 'Document' when 1 then 'P' else 'Span' end as kind from t""")
def nested_elements(spark, d):
    """Elements of nested files with the pages they inherit."""
    return payload.nested_elements(trees(spark, d)).select("doc_id", "id", "parent", "page_ix", "depth", "text", "kind")


_PROFILE = f"""with {_NODES}, s as (select l.doc, case when l_linenumber = 5 then l.page + 1000 else l.page end as page, i, j, k, l_returnflag || l_linestatus as text, l_suppkey as s, l_returnflag, l_linestatus, l_quantity, l_tax, l_discount, l_linenumber
  from l join o on o.doc = l.doc and o.l_orderkey = l.l_orderkey join p on p.doc = l.doc and p.page = l.page),
r as (select *, 'regular' as reg, 'irregular' as irr from s), u as (
  select doc, page, i, j, k, 'embedded' as prop, case l_returnflag when 'R' then 'True' when 'N' then 'False' end as value from r
  union all select doc, page, i, j, k, 'encoding', case s % 3 when 0 then 'WinAnsi' when 1 then 'None' end from r union all select doc, page, i, j, k, 'family_name', 'Fam' || (s % 4) from r
  union all select doc, page, i, j, k, 'name', case when s % 7 = 0 then 'Unknown' else 'F' || (s % 7) end from r union all select doc, page, i, j, k, 'monospaced', case when l_linestatus = 'O' then 'True' else 'False' end from r
  union all select doc, page, i, j, k, 'subset', case when l_quantity > 25 then 'True' end from r union all select doc, page, i, j, k, 'has_clip', case when l_tax > 0.05 then 'True' else 'False' end from r
  union all select doc, page, i, j, k, 'text_size', case when l_discount = 0 then reg else irr end from r union all select doc, page, i, j, k, 'line_height', case when l_linenumber <> 2 then reg end from r),
c as (select doc, prop, value, page, count(*) as n from u where value is not null group by all), h as (select doc, prop, value, cast(sum(n) as bigint) as n, min(n) as least_page from c group by all),
w as (select *, cast(sum(n) over (partition by doc, prop) as bigint) as total, row_number() over (partition by doc, prop order by n desc, value) as rank from h),
f as (select doc, prop, value, string_agg(page || ':' || i || '.' || j || '.' || k, ' ' order by i, j, k) as items from (select * from u where value is not null qualify row_number() over (partition by doc, prop, value order by i, j, k) <= 5) group by all)
"""


@query(_PROFILE + "select doc as doc_id, prop, value, n, total, round(100.0 * n / total, 6) as pct, cast(rank as integer) as rank, least_page, items from w join f using (doc, prop, value)")
def property_profile(spark, d):
    """Nine properties of the elements: values, shares, ranks, the smallest count on a page, and each value's first five items."""
    p = profile.profile(payload.nested_elements(trees(spark, d)), profile.ELEMENTS, order=("place",), item=("id",), keep=5)
    items = F.array_join(F.transform("items", lambda x: F.concat(x["page"].cast("string"), F.lit(":"), x["id"])), " ")
    return p.select("doc_id", "prop", "value", "n", "total", F.round("pct", 6).alias("pct"), "rank", "least_page", items.alias("items"))


@query(_PROFILE + "select doc as doc_id, prop, value, n, n < 4 or 100.0 * n / total < 2 or (prop in ('text_size', 'line_height') and least_page <= 5) as rare, n < greatest(5, 0.05 * total) as uncommon from w where n < 4 or 100.0 * n / total < 2 or (prop in ('text_size', 'line_height') and least_page <= 5) or n < greatest(5, 0.05 * total)")
def rare_properties(spark, d):
    """Values of the nine properties that are rare or uncommon."""
    h = profile.histogram(payload.nested_elements(trees(spark, d)), profile.ELEMENTS)
    return h.select("doc_id", "prop", "value", "n", profile.is_rare().alias("rare"), profile.is_uncommon().alias("uncommon")).filter("rare or uncommon")


_TEXTS = """g as (select doc, prop, value, list(text order by i, j, k) as texts from (select u.*, r.text from u join r using (doc, i, j, k) where value is not null qualify row_number() over (partition by doc, prop, value order by i, j, k) <= 5) group by all),
a as (select w.*, texts, n < greatest(5, 0.05 * total) as odd, printf('%.1f', 100.0 * n / total) as pct from w join g using (doc, prop, value)),
d as (select distinct doc from l), pr as (select doc, prop, count(*) as v, min(value) as sole, count(*) filter (odd) as o from a group by all),
pk as (select *, row_number() over (partition by doc order by v > 1, prop) as q from pr),
lines as (select doc, 0 as s, 0 as x, 0 as y, 0 as z, '# Report on ' || doc as line from d
  union all select doc, 1, 0, 0, 0, '## Kind of document' from d union all select doc, 1, 0, 1, 0, case when doc % 2 = 0 then '- Has a text layer' else '- Scanned, without a text layer' end from d
  union all select doc, 1, 0, 2, 0, '- Read by ' || case when doc % 2 = 0 then 'structure' else 'ocr' end from d union all select doc, 1, 0, 3, 0, '- No restrictions' from d where doc % 3 = 0
  union all select doc, 1, 0, 3, 0, '- Not allowed: print, copy' from d where doc % 3 = 1
  union all select doc, 2, 0, 0, 0, '## Fonts' from d union all select doc, 2, 0, 1, 0, case when o > 0 then o || ' of ' || v || ' fonts are uncommon:' else 'All ' || v || ' fonts are common.' end from pr where prop = 'name'
  union all select doc, 2, 1, f, unnest(range(len(t))), unnest(t) from (select doc, row_number() over (partition by doc order by n, value) as f,
    ['### ' || value, '- ' || n || ' items (' || pct || '%)'] || list_transform(texts, lambda c: '  - "' || c || '"') || case when n > 5 then ['  - and ' || (n - 5) || ' more'] else [] end as t from a where prop = 'name' and odd)
  union all select doc, 3, 0, 0, 0, '## Properties of elements' from d
  union all select doc, 3, 1, q, 0, '- ' || prop || ': ' || case when v = 1 then 'always ' || sole when o = 0 then v || ' values, all common' else v || ' values, ' || o || ' uncommon' end from pk
  union all select a.doc, 3, 1, q, row_number() over (partition by a.doc, a.prop order by n, value), '  - ' || value || ': ' || n || ' items (' || pct || '%), such as ' || array_to_string(list_transform(texts[1:3], lambda c: '"' || c || '"'), ', ') from a join pk using (doc, prop) where odd and v > 1
  union all select doc, 8, 0, 0, 0, '---' from d union all select doc, 8, 0, 1, 0, 'End of report' from d)"""


@query(_PROFILE + ", " + _TEXTS + " select doc as doc_id, count(*) as n_lines, string_agg(line, chr(10) order by s, x, y, z) as report from lines group by 1")
def report_texts(spark, d):
    """The report of each document of nested elements: its kind, uncommon fonts with their texts, properties."""
    t = trees(spark, d)
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3
    restrictions = F.when(third == 0, F.array().cast("array<string>")).when(third == 1, F.array(F.lit("print"), F.lit("copy")))
    docs = t.select("doc_id", even.alias("has_text"), F.when(even, "structure").otherwise("ocr").alias("pipeline"), restrictions.alias("restrictions"), F.lit(None).cast("string").alias("error"))
    p = profile.profile(payload.nested_elements(t), profile.ELEMENTS, order=("place",), keep=sections.FONT_TEXTS)
    return sections.assemble(sections.title(docs), sections.kind(docs), sections.fonts(docs, p, "name"), sections.properties(docs, p), sections.end(docs))
