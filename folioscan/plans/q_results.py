"""Queries over stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators import results, versions
from folioscan.operators.lineage import new_folder
from folioscan.plans import views as v
from folioscan.plans.registry import query


def _per_document(todo: DataFrame) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return todo.groupBy("doc_id", "fingerprint").agg(F.sum(words).cast("long").alias("words"))


@query("""with d as (select doc_id, coalesce(text, '') as text, row_number() over (partition by doc_id, text order by lang) as nth from documents)
select doc_id, cast(len(regexp_extract_all(text, '\\S+')) as bigint) as words, count(*) over () as computed, 0 as again, count(*) filter (doc_id % 10 = 3) over () as changed from d where nth = 1""")
def resumed_results(spark, d):
    """Words of each document from a store that three runs made: all documents, nothing new, and a tenth with one letter more and back."""
    docs = v.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = new_folder(spark, "results")
    run = lambda rows: results.resume(rows, {"unit": "words"}, _per_document, path)
    first, again = run(docs), run(docs)
    changed = run(docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text"))))
    stored = results.current(docs, {"unit": "words"}, path)
    return stored.select("doc_id", "words", F.lit(first).cast("long").alias("computed"), F.lit(again).alias("again"), F.lit(changed).cast("long").alias("changed"))


_VERSIONS = f"""{v.BOXES}, was as (select page_ix, min(box_id) as box_id, x0, y0, min(x1) as x1, min(y1) as y1, min(text) as text from boxes group by page_ix, x0, y0),
now as (select page_ix, 1000 + box_id as id, box_id, case when box_id % 13 = 0 then null when box_id % 7 = 0 then text || '?' else text end as text, case when box_id % 5 = 0 then 3.0 else box_id % 4 * 0.5 end as moved from was where box_id % 11 <> 0)"""


@query(f"""with {_VERSIONS}, j as (select coalesce(w.page_ix, n.page_ix) as page_ix, w.box_id as old, n.id as new, w.text as a, n.text as b, moved from was w full join (select * from now where moved <= 2) n on w.page_ix = n.page_ix and w.box_id = n.box_id
  union all select page_ix, null, id, null, text, null from now where moved > 2)
select page_ix, old, new, case when old is null then 'added' when new is null then 'lost' when a is distinct from b then 'changed' else 'same' end as status, case when old is not null and new is not null then case when a is distinct from b then 'text' else '' end end as changed, cast(moved as double) as moved from j""")
def versions_compared(spark, d):
    """Boxes beside a later version of them: some moved a little, some too far, some gone, some with another text or none."""
    b = v.boxes(spark, d)
    was = b.groupBy("page_ix", "x0", "y0").agg(*[F.min(c).alias(c) for c in ("box_id", "x1", "y1", "text")])
    k = F.col("box_id")
    move = F.when(k % 5 == 0, 3.0).otherwise(k % 4 * 0.5)
    text = F.when(k % 13 == 0, None).when(k % 7 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    now = was.filter(k % 11 != 0).select("page_ix", *[(F.col(c) + move).alias(c) for c in ("x0", "y0", "x1", "y1")], text.alias("text"), (k + 1000).alias("box_id"))
    found = versions.compare(was, now, ["page_ix"], "box_id", ["text"])
    return found.withColumn("changed", F.array_join("changed", ",")).withColumn("moved", F.round("moved", 9))
