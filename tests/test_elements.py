"""Fonts of spans: equal to comparing every name with every font, without a nested loop."""

import random
import string

from pyspark.sql import functions as F

from folioscan.operators import elements


def test_fonts_equal_all_pairs(spark):
    rng = random.Random(2)
    word = lambda lo, hi: "".join(rng.choice("abAB+-1") for _ in range(rng.randint(lo, hi)))
    spans = [(d, i, word(0, 7) if i % 3 else "TAG+" + word(5, 14)) for d in range(6) for i in range(40)] + [(1, 90, None)]
    fonts = [(d, i, word(1, 5) if i % 2 else word(6, 16)) for d in range(6) for i in range(25)] + [(2, 50, None), (3, 51, "")]
    got = {(r.doc_id, r.span_index): (r.font_id, r.font_name) for r in elements.font_of(spark.createDataFrame(spans, "doc_id long, span_index long, font string"), spark.createDataFrame(fonts, "doc_id long, font_id long, name string")).collect()}
    want = {(d, i): min(((k, n) for e, k, n in fonts if e == d and f is not None and n is not None and (n in f or f in n)), default=(None, None)) for d, i, f in spans}
    assert got == want and any(v[0] is not None for v in want.values())


def test_twenty_thousand_shared_fonts(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice(string.ascii_letters) for _ in range(12)) for _ in range(20_000)})
    fonts = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "font_id long, name string")
    spans = fonts.select((F.col("font_id") % 500).alias("doc_id"), F.col("font_id").alias("span_index"), F.concat(F.lit("ABCDEF+"), "name").alias("font"))
    found = elements.font_of(spans, fonts, ())
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.filter("font_id = span_index and font_name = substr(font, 8)").count() == len(names)
