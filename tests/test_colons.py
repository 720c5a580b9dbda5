"""Colon findings, case by case."""

from folioscan.operators import colons, pairs


def test_each_rule(spark):
    names = "page_ix long, pair_id long, label string, value string, spacing double, value_x0 double, value_x1 double, same_cell boolean, cell_x0 double"
    usual = [(p, i, "l", "v", 4.0 + i / 10, 100.0 + 9 * i, 150.0 + 7 * i, False, None) for p in (0, 1) for i in range(3)]
    odd = [
        (0, 10, "l", "R 12.00", 18.0, 300.0, 333.0, False, None), (0, 11, "l", "John Smith", 18.0, 60.0, 340.0, False, None), (0, 12, "l", "x y z", 18.0, 310.0, 352.0, False, None), (0, 13, "l", "x", 9.0, 311.0, 366.0, None, None),
        (0, 14, "l", "x", 0.0, 1.0, 2.0, True, 41.0), (0, 15, "l", "2020/01/31", 0.0, 1.0, 2.0, True, 80.0),
        (1, 20, "l", "x", 30.0, 400.0, 500.0, False, None), (1, 21, "l", "x", 31.0, 400.0, 500.4, False, None), (1, 22, "l", "x", 32.0, 400.0, 520.0, None, None), (1, 23, "l", "x", 0.0, 1.0, 600.0, True, 40.0),
        (2, 30, "l", "x", 4.0, 1.0, 2.0, False, None), (3, 31, "l", "x", 4.0, 1.0, 2.0, False, None), (3, 32, "l", "x", 9.0, 1.0, 2.0, False, None),
    ]
    base = spark.createDataFrame([(0, "left", 40.0, 3), (0, "left", 61.0, 5), (0, "left", 300.0, 2), (0, "right", 352.5, 9), (0, "right", 333.0, 1)], "page_ix long, side string, value double, count int")
    pairs = spark.createDataFrame(usual + odd, names)
    got = {r.pair_id: (r.classification, r.content_type, r.severity) for r in colons.findings(pairs, ["page_ix"], base).filter("pair_id >= 10").collect()}
    assert got == {
        10: ("deviation", "currency", "HIGH"), 11: ("consistent", "name", None), 12: ("right_aligned", "text", None), 13: ("deviation", "text", "LOW"), 14: ("consistent", "text", None), 15: ("deviation", "date", "LOW"),
        20: ("right_aligned", "text", None), 21: ("right_aligned", "text", None), 22: ("deviation", "text", "LOW"), 23: ("deviation", "text", "LOW"),
    }
    assert {r.reason for r in colons.findings(pairs, ["page_ix"], base).filter("pair_id = 10").collect()} == {"off by 13.9 (spacing 18.0, usual 4.1): an amount of money"}
    plain = {r.pair_id: r.classification for r in colons.findings(pairs, ["page_ix"]).collect()}
    assert plain[14] == "deviation" and plain[10] == "deviation" and 30 not in plain and 31 not in plain
    assert colons.findings(pairs.limit(0), ["page_ix"], base).count() == 0


def test_a_cell_without_a_place_is_no_value(spark):
    rows = [(1, 0, "Name:", 0.0, 30.0, 5.0), (1, 1, "lost", None, None, None), (1, 2, "Ann", 35.0, 50.0, 5.0), (1, 3, "Lee", 55.0, 70.0, 5.0), (1, 4, "Age:", 0.0, 20.0, 30.0)]
    cells = spark.createDataFrame(rows, "page long, i long, text string, x0 double, x1 double, y0 double").repartition(3)
    got = pairs.chained_pairs(cells, ["page"], "i")
    assert [(r.i, r.label, r.value, r.spacing, r.value_x1) for r in got.collect()] == [(0, "Name", "Ann Lee", 5.0, 70.0)]
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()  # a page's rows aren't made records one by one
