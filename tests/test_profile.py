"""Nested elements and property profiles, on files and against plain readings of their rules."""

import json
from collections import Counter

from pyspark.sql import functions as F

from folioscan.operators import profile
from folioscan.sources import payload


def walk(nodes, above=None, place=()):
    for i, n in enumerate(nodes):
        if isinstance(n, dict):
            page = n.get("Page", above)
            yield (*place, i), page, n
            if isinstance(n.get("Kids"), list):
                yield from walk(n["Kids"], page, (*place, i))


def deep(k):
    return {"Path": f"//Document/P[{k}]", "Text": f"t{k}", **({"Page": k} if k % 10 == 0 else {}), "Kids": [deep(k - 1), {"Text": 5}, "no element", 7]} if k else {"Text": "leaf"}


TREE = [
    {"Path": "//Document/Sect/P[1]", "Page": 3, "Text": "a", "Font": {"embedded": True, "encoding": "", "name": "F", "family_name": "", "monospaced": False}, "TextSize": 12.25, "LineHeight": "14.3", "BBox": [4, 3, 2, 1], "Kids": [
        {"Text": "b", "Kids": [{"Text": "c", "attributes": {"LineHeight": 9, "BBox": {"l": 1, "t": 2, "r": 3, "b": 4}}, "Kids": [{"Text": "d", "Page": None, "Kids": [{"Text": "e"}]}]}]},
        {"Text": None, "Page": 4, "HasClip": False, "Bounds": {"x0": 1, "y0": 1, "x1": 2, "y1": 2}, "TextSize": "wide", "Kids": {"not": "a list"}}]},
    9, {"Text": "f", "Font": "none"},
]


def test_nested_elements_of_files(spark, tmp_path):
    for name, body in (("one", json.dumps({"elements": TREE})), ("deep", json.dumps({"elements": [deep(50)]})), ("bad", "{"), ("list", "[1]"), ("none", "{}")):
        (tmp_path / f"{name}.json").write_text(body)
    trees = payload.read_trees(spark, str(tmp_path))
    assert {r.doc_id for r in trees.filter("_error is not null").collect()} == {"bad"}
    rows = payload.nested_elements(trees).persist()
    for name, tree in (("one", TREE), ("deep", [deep(50)])):
        got = {tuple(r.place): (r.page_ix, r.text, r.parent, r.depth) for r in rows.filter(F.col("doc_id") == name).collect()}
        want = {p: (page, None if n.get("Text") is None else str(n["Text"]), ".".join(map(str, p[:-1])) or None, len(p) - 1) for p, page, n in walk(tree)}
        assert got == want
    assert rows.count() == sum(1 for t in (TREE, [deep(50)]) for _ in walk(t)) and rows.agg(F.max("depth")).first()[0] == 50
    one = {r.id: r for r in rows.filter("doc_id = 'one'").collect()}
    assert (one["0"].kind, one["0"].x0, one["0"].y1, one["0"].bbox_source, one["0"].line_height) == ("P", 2, 3, "BBox", 14.3)
    assert (one["0.0.0"].line_height, one["0.0.0"].bbox_source, one["0.1"].bbox_source, one["0.1"].text_size, one["0.1"].has_clip) == (9, "attributes.BBox", "Bounds", None, False)
    tree = payload.flatten_elements(rows.select("doc_id", "id", "parent", F.when(F.col("depth") == 0, F.col("page_ix")).alias("page")))
    assert tree.count() == rows.count()
    got = {(r.prop, r.value): (r.n, r.total, r.items[0].text, r.items[0].exact) for r in profile.profile(rows.filter("doc_id = 'one'"), profile.ELEMENTS, order=("place",)).collect()}
    assert got == {
        ("embedded", "True"): (1, 1, "a", None), ("encoding", "None"): (1, 1, "a", None), ("family_name", "Unknown"): (1, 1, "a", None), ("name", "F"): (1, 1, "a", None), ("monospaced", "False"): (1, 1, "a", None),
        ("has_clip", "False"): (1, 1, None, None), ("text_size", "regular"): (1, 1, "a", 12.25), ("line_height", "irregular"): (1, 2, "a", 14.3), ("line_height", "regular"): (1, 2, "c", 9.0),
    }


def test_profile_of_spans_words_and_cells(spark):
    rows = [(d, p, i, ["Arial", "Times", "", None][i * 7 % 4], [12.0, 11.3, None][i % 3], i % 2 * 255, 0, 0, f"w{i}") for d in range(2) for p in range(3) for i in range(d * 20 + 9)]
    df = spark.createDataFrame(rows, "doc_id long, page_ix long, span_index long, font string, size double, red int, green int, blue int, text string")
    got = {(r.doc_id, r.prop, r.value): r for r in profile.profile(df, profile.SPANS, order=("page_ix", "span_index"), keep=4).collect()}
    flags = {(r.doc_id, r.prop, r.value): (r.a, r.b) for r in profile.histogram(df, profile.SPANS).select("*", profile.is_rare().alias("a"), profile.is_uncommon().alias("b")).collect()}
    values = {"font": lambda r: r[3] or None, "size": lambda r: None if r[4] is None else "regular" if r[4] == 12 else "irregular", "color": lambda r: str(r[5] * 65536)}
    for prop, of in values.items():
        for d in range(2):
            mine = [r for r in rows if r[0] == d and of(r) is not None]
            count, pages = Counter(map(of, mine)), Counter((of(r), r[1]) for r in mine)
            for rank, (v, n) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0])), 1):
                r = got.pop((d, prop, v))
                assert (r.n, r.total, r.rank, r.least_page) == (n, len(mine), rank, min(k for (w, _), k in pages.items() if w == v))
                assert [(x.page, x.text, x.exact) for x in r.items] == [(x[1], x[8], x[4] if prop == "size" else None) for x in mine if of(x) == v][:4]
                assert flags[d, prop, v] == (n < 4 or 100 * n / len(mine) < 2 or (prop == "size" and r.least_page <= 5), n < max(5, 0.05 * len(mine)))
    assert not got
    cells = spark.createDataFrame([(1, 0, "Unknown", "a"), (1, 1, "F", "b")], "doc_id long, page_ix long, font_name string, text string")
    assert profile.rare(profile.histogram(cells, profile.CELLS)).count() == 2 and profile.uncommon(profile.histogram(cells, profile.CELLS)).count() == 2
    assert profile.histogram(df, profile.WORDS).count() == 8


def test_a_value_of_very_many_items_stays_bounded(spark):
    df = spark.range(200_000).select(F.lit(1).alias("doc_id"), (F.col("id") % 90).alias("page_ix"), "id", F.lit("Arial").alias("font_name"), F.lit("x").alias("text"))
    found = profile.first_items(df, profile.CELLS, order=("page_ix", "id"), item=("text", "id"), keep=5)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert [x.id for x in found.first().items] == [0, 90, 180, 270, 360]


def test_profile_reads_its_items_once(spark):
    rows = [("a" if i % 7 else None, i % 5 if i % 11 else None, i // 3, f"t{i}", ["F", "G", "", None][i % 4], i + (i % 3) / 4) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id string, page_ix int, at int, text string, font string, size double").repartition(3)
    got = profile.profile(df, profile.WORDS, order=("at", "text"), keep=4)
    assert "Expand" not in got._jdf.queryExecution().toString()
    plain = profile.histogram(df, profile.WORDS).join(profile.first_items(df, profile.WORDS, order=("at", "text"), keep=4), ["doc_id", "prop", "value"])
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.select(*got.columns).collect())) and got.count() == 3
