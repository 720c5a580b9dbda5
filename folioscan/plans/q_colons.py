"""Queries over label/value pairs with different contents, edges and spacings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators import colons, pairs
from folioscan.plans import views as v
from folioscan.plans.registry import query

#: What stands in place of a value, by the pair's number, and what content that is.
_OTHER = {1: ("John Smith", "name"), 2: ("2020/01/31", "date"), 3: ("ok then", "text")}

_PAIRS = f"""{v.FORMS}, pairs as (select page_ix, pair_id, case pair_id % 4 {" ".join(f"when {k} then '{t}'" for k, (t, _) in _OTHER.items())} else 'R ' || value end as value, spacing, value_x0,
    case when pair_id % 3 = 0 then 180.0 + pair_id % 2 else value_x1 end as value_x1, pair_id % 5 = 0 as same_cell, cast(40 + pair_id % 3 * 2 as double) as cell_x0, case pair_id % 4 {" ".join(f"when {k} then '{c}'" for k, (_, c) in _OTHER.items())} else 'currency' end as content_type from forms),
base as (select page_ix, list(value) filter (side = 'left') as ls, list(value) filter (side = 'right') as rs from (
  select page_ix, 'left' as side, value_x0 as value, count(*) as n from pairs where page_ix % 2 = 0 group by all union all select page_ix, 'left', cell_x0, count(*) from pairs where page_ix % 2 = 0 and cell_x0 < 44 group by all
  union all select page_ix, 'right', value_x1, count(*) from pairs where page_ix % 2 = 0 group by all) where n >= 3 group by 1),
bk as (select page_ix, round_even(spacing * 2, 0) / 2 as bucket, count(*) as n, avg(spacing) as dominant from pairs group by 1, 2),
dom as (select * from bk qualify row_number() over (partition by page_ix order by n desc, bucket) = 1), j as (
  select p.*, dominant, abs(spacing - dominant) as deviation, coalesce(len(list_filter(b.ls, lambda e: abs(value_x0 - e) <= 1.5)), 0) > 0 as on_left, coalesce(len(list_filter(b.ls, lambda e: abs(cell_x0 - e) <= 1.5)), 0) > 0 as cell_on_left,
    case when p.page_ix % 2 = 0 then coalesce(len(list_filter(b.rs, lambda e: abs(value_x1 - e) <= 1.5)), 0) > 0 else count(*) over (partition by p.page_ix, round_even(value_x1 * 0.67, 0)) >= 2 end as on_right
  from pairs p join dom on p.page_ix = dom.page_ix and dom.n >= 3 left join base b on b.page_ix = p.page_ix),
k as (select *, case when same_cell then case when cell_on_left then 'consistent' else 'deviation' end when on_left then 'consistent' when on_right then 'right_aligned' when deviation <= 2 then 'consistent' else 'deviation' end as classification,
  cast(case content_type when 'currency' then 2.5 when 'name' then 3.0 else 1.0 end as double) as weight, case content_type {" ".join(f"when '{c}' then '{t}'" for c, t in colons.CALLED.items())} end as called,
  'spacing ' || printf('%.1f', spacing) || ', usual ' || printf('%.1f', dominant) as spaced from j)"""


def _pairs(spark, d) -> DataFrame:
    f, k = v.forms(spark, d), F.col("pair_id") % 4
    value = F.when(k == 0, F.concat(F.lit("R "), "value"))
    for n, (text, _) in _OTHER.items():
        value = F.when(k == n, text).otherwise(value)
    x1 = F.when(F.col("pair_id") % 3 == 0, 180.0 + F.col("pair_id") % 2).otherwise(F.col("value_x1"))
    return f.select("page_ix", "pair_id", value.alias("value"), "spacing", "value_x0", x1.alias("value_x1"), (F.col("pair_id") % 5 == 0).alias("same_cell"), (40 + F.col("pair_id") % 3 * 2).cast("double").alias("cell_x0"))


def _baselines(pairs: DataFrame) -> DataFrame:
    """Edges of every second page as baselines."""
    rows = pairs.filter("page_ix % 2 = 0")
    one = lambda side, c, some=rows: some.groupBy("page_ix", F.col(c).alias("value")).agg(F.count("*").alias("count")).select("page_ix", F.lit(side).alias("side"), "value", "count")
    return one("left", "value_x0").unionByName(one("left", "cell_x0", rows.filter("cell_x0 < 44"))).unionByName(one("right", "value_x1"))


@query(f"""with {_PAIRS} select page_ix, pair_id, round(deviation, 6) as deviation, classification, content_type, weight, case when classification = 'deviation' then case when weight >= 2.5 then 'HIGH' when weight > 1 then 'MEDIUM' else 'LOW' end end as severity,
  case when same_cell and classification = 'consistent' then 'one cell, begins on a left baseline (' || printf('%.1f', cell_x0) || ')' when same_cell then 'one cell, begins on no baseline (' || printf('%.1f', cell_x0) || '): ' || called
    when classification = 'deviation' then 'off by ' || printf('%.1f', deviation) || ' (' || spaced || '): ' || called when classification = 'right_aligned' then 'meets a right edge, ' || spaced when on_left then 'begins on a left baseline, ' || spaced else 'as usual, ' || spaced end as reason from k""")
def colon_findings(spark, d):
    """Class, content, severity and reason of every pair, on pages with baselines and on pages without."""
    pairs = _pairs(spark, d)
    found = colons.findings(pairs, ["page_ix"], _baselines(pairs))
    return found.select("page_ix", "pair_id", F.round("deviation", 6).alias("deviation"), "classification", "content_type", "weight", "severity", "reason")


_PARTS = """parts as (select cast(o_orderkey // 40 as bigint) as page_ix, o_orderkey as pair_id, o_orderpriority as label, cast(40 + 6 * length(o_orderpriority) + 6 as double) as label_x1, o_orderstatus as a, printf('%.2f', o_totalprice) as b, 'no ' || o_custkey as c,
  case when o_custkey % 4 = 0 then 25.0 else 5.0 end as gap from orders)"""


@query(f"""with {_PARTS} select page_ix, pair_id, label, case when gap > 20 then a || ' ' || b else a || ' ' || b || ' ' || c end as value, cast(4 as double) as spacing,
  label_x1 + 4 + 6 + 5 + 6 * length(b) + case when gap > 20 then 0 else gap + 6 * length(c) end as value_x1 from parts""")
def chained_values(spark, d):
    """Labels whose value is spread over three cells; where the last one is far off, the chain ends before it."""
    o = v.table(spark, d, "orders")
    page, row = F.floor(F.col("o_orderkey") / 40).cast("long"), (F.col("o_orderkey") % 40 * 14).cast("double")
    label, price, number = F.concat("o_orderpriority", F.lit(":")), F.format_string("%.2f", "o_totalprice"), F.concat(F.lit("no "), F.col("o_custkey").cast("string"))
    at = (40 + 6 * F.length(label)).cast("double")
    first = at + 4
    second = first + 6 + 5
    third = second + 6 * F.length(price) + F.when(F.col("o_custkey") % 4 == 0, 25.0).otherwise(5.0)
    cell = lambda k, text, x0: F.struct((F.col("o_orderkey") * 4 + k).alias("cell"), text.alias("text"), x0.alias("x0"), (x0 + 6 * F.length(text)).alias("x1"))
    cells = o.select(page.alias("page_ix"), row.alias("y0"), F.explode(F.array(cell(0, label, F.lit(40.0)), cell(1, F.col("o_orderstatus"), first), cell(2, price, second), cell(3, number, third))).alias("c")).select("page_ix", "y0", "c.*")
    return pairs.chained_pairs(cells, ["page_ix"], "cell").select("page_ix", F.floor(F.col("cell") / 4).cast("long").alias("pair_id"), "label", "value", "spacing", "value_x1")
