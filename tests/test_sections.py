"""Reports put together from sections, advice by rules, and the record of a document's logic."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from folioscan.operators import profile, sections


def test_a_whole_report(spark, tmp_path):
    docs = spark.createDataFrame([("a b", True, "docling", ["copy"], None), ("b", False, "azure", None, None), ("c", True, "docling", [], "no pages")], "doc_id string, has_text boolean, pipeline string, restrictions array<string>, error string")
    cells = [("a b", 0, i, "Arial", f"t{i}") for i in range(200)] + [("a b", 1, i, "Odd", f"o{i}") for i in range(7)] + [("b", 0, 0, "F", "x")] * 6
    profiled = profile.profile(spark.createDataFrame(cells, "doc_id string, page_ix int, cell_index int, font_name string, text string"), profile.CELLS, order=("page_ix", "cell_index"))
    hidden = spark.createDataFrame([("a b", 0, i, f"h{i}", "overlap") for i in range(23)], "doc_id string, page_ix int, cell_index int, text string, kind string")
    names = ["fg_luminance", "max_grad", "other"]
    items = [("a b", i, f"w{i}", 3 if i == 4 else 2 if i == 2 else 0, [3.0 if i == 4 else 0.1, -4.0 if i == 4 else 0.0, 0.0], names, i % 2 - (i == 9)) for i in range(30)]
    scored = spark.createDataFrame(items, "doc_id string, id int, text string, votes int, z array<double>, names array<string>, cluster int")
    checks = spark.createDataFrame([("a b", 1, 0, None, 0), ("b", 0, 3, 1, 5)], "doc_id string, inverted_tables int, tables int, pictures_from_below int, baselines int")
    out = sections.assemble(
        sections.title(docs), sections.kind(docs), sections.fonts(docs, profiled), sections.properties(docs, profiled), sections.hidden(docs, hidden), sections.anomalies(docs, scored), sections.groups(docs, scored), sections.advice(checks), sections.end(docs)
    )
    got = {r.doc_id: r.report.split("\n") for r in out.collect()}
    want = [
        "# Report on a b", "## Kind of document", "- Has a text layer", "- Read by docling", "- Not allowed: copy",
        "## Fonts", "1 of 2 fonts are uncommon:", "### Odd", "- 7 items (3.4%)", '  - "o0"', '  - "o1"', '  - "o2"', '  - "o3"', '  - "o4"', "  - and 2 more",
        "## Properties of elements", "- font_name: 2 values, 1 uncommon", '  - Odd: 7 items (3.4%), such as "o0", "o1", "o2"',
        "## Hidden text", "23 texts are in the file but not in sight:", *[f'{i + 1}. "h{i}", overlap' for i in range(20)], "and 3 more",
        "## Anomalies", "2 of 30 items (6.7%): 1 by all three methods, 1 by two", '1. [HIGH] "w4"', "   - max_grad (-4.00): no place is cut hard", "   - fg_luminance (+3.00): the ink is paler", '2. [MEDIUM] "w2"', "   - no single feature stands out",
    ]
    assert got["a b"][: len(want)] == want
    rest = got["a b"][len(want) :]
    assert rest[:3] == ["## Smallest clusters", "2 clusters, 0 items in none", "### Cluster 1 (14 items)"] and rest[13] == "and 4 more items"
    assert rest[3:13] == [f'{k + 1}. "w{i}"' for k, i in enumerate([1, 3, 5, 7, 11, 13, 15, 17, 19, 21])] and rest[14] == "- max_grad (58.0%), mean +0.00: no place is cut hard"
    assert rest[-6:] == ["## Recommendations", *["- " + sections.RULES[k][2] for k in (0, 1, 3)], "---", "End of report"]
    assert got["b"][:5] == ["# Report on b", "## Kind of document", "- Scanned, without a text layer", "- Read by azure", "## Fonts"]
    assert {"All 1 fonts are common.", "- font_name: always F", "No hidden text.", "No scores.", "No clusters.", "- " + sections.RULES[2][2]} <= set(got["b"])
    assert got["c"][1] == "Processing failed: no pages" and {"No data on fonts.", "No data on properties."} <= set(got["c"]) and got["c"][-2:] == ["---", "End of report"]
    sections.write_texts(out, str(tmp_path / "out"))
    files = {p.parent.name: p.read_text() for p in Path(tmp_path / "out").glob("document=*/*.txt")}
    assert len(files) == 3 and files["document=b"] == "\n".join(got["b"]) + "\n" and sum(k.startswith("document=a_b-") for k in files) == 1


def test_the_record_of_a_document(spark):
    rows = [
        ("d", None, 1, "payload", "cells", '"old"'), ("d", None, 2, "payload", "cells", '"a\\"b.json"'), ("d", None, 3, "note", None, '"first"'), ("d", None, 9, "note", None, '"second"'),
        ("d", 0, 4, "overview", None, '{"cells": 3, "width": 612.5}'), ("d", 0, 5, "overview", None, '{"cells": 4}'), ("d", 0, 6, "baselines", "initial", '{"left": [1, 2]}'), ("d", 0, 7, "baselines", "refined", "[]"), ("d", 0, 8, "baselines", "initial", '{"left": [3]}'),
        ("d", 0, 10, "text_blocks", "final", '{"n": 2}'), ("d", 1, 11, "colon_spacing", None, '{"n": 1}'), ("d", 1, 12, "colon_spacing", None, '{"n": 2}'), ("d", 1, 14, "event", "split", '{"x": 1}'), ("d", 1, 13, "event", "merge", "{}"), ("d", 1, 15, "highlight", "text \"block\"", '{"bbox": [1, 2]}'),
        ("e", None, 1, "note", None, '"alone"'),
    ]
    got = {r.doc_id: json.loads(r.report) for r in sections.logic(spark.createDataFrame(rows, "doc_id string, page_ix int, seq int, kind string, name string, body string")).collect()}
    empty = {"overview": {}, "baselines": {}, "text_blocks": {}, "colon_spacing": {}, "highlighted_items": [], "events": []}
    assert got["d"] == {
        "document": {"label": "d", "payloads": {"cells": 'a"b.json'}}, "notes": ["first", "second"],
        "pages": {
            "0": {**empty, "overview": {"cells": 4, "width": 612.5}, "baselines": {"initial": {"left": [3]}, "refined": []}, "text_blocks": {"final": {"n": 2}}},
            "1": {**empty, "colon_spacing": {"n": 2}, "events": [{"category": "merge"}, {"category": "split", "x": 1}], "highlighted_items": [{"type": 'text "block"', "bbox": [1, 2]}]},
        },
    }
    assert got["e"] == {"document": {"label": "e", "payloads": {}}, "notes": ["alone"], "pages": {}}


def test_percents_are_those_of_printf(spark):
    values = [100.0 * n / total for total in (7, 16, 40, 400, 2000) for n in range(total + 1)] + [6.25, 6.75, 12.35, 0.05, 0.25, 99.95, 100.0]
    got = spark.createDataFrame([(x,) for x in values], "c double").select("c", sections._percent(F.col("c")).alias("p")).collect()
    assert [r.p for r in got] == [f"{r.c:.1f}" for r in got]
