"""Baselines and blocks against the reference cases of FIXTURES.md and against plain readings of their rules."""

import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.functions import geometry as g
from folioscan.operators import alignment, baselines, blocks, kernels
from folioscan.plans import registry, views

registry.load()
SF = "/root/testdata/sf0.001"


def block(box, cells, share, alignment="left", name=1):
    return {"block_id": name, "bbox": box, "cells": cells, "alignment": alignment, "share": share}


def test_confidence_cases(spark):
    cases = [((0, 0, 300, 300), 30, 0.95, True), ((0, 0, 200, 300), 3, 0.5, False), ((0, 0, 200, 200), 12, 0.75, False), ((0, 0, 100, 0), 4, 1.0, False)]
    got = [kernels.block_confidence(b, n, a, [b] if t else []) for b, n, a, t in cases]
    assert got[0] >= 0.8 and got[1] <= 0.5 and 0.4 <= got[2] <= 0.7 and got[0] == 0.938
    assert kernels.block_confidence((0, 0, 300, 300), 30, 0.95) == pytest.approx(got[0] - 0.2)
    rows = spark.createDataFrame([(*map(float, b), n, a, t) for b, n, a, t in cases], "x0 double, y0 double, x1 double, y1 double, cells long, share double, t boolean")
    assert [r.c for r in rows.select(blocks.confidence(F.col("cells"), F.col("share"), F.col("t"), g.box()).alias("c")).collect()] == pytest.approx(got, abs=0.0011)


def test_refinement_cases():
    weak, strong = (0, 0, 100, 300), (0, 0, 100, 100)
    kept, counts = blocks.refine_page([block(strong, 15, 0.5, "mixed"), block(weak, 3, 0.5, "mixed", 2)], [])
    assert [b["block_id"] for b in kept] == [1] and counts["after_nesting"] == 2 and counts["final_count"] == 1
    assert len(blocks.refine_page([block(weak, 3, 0.5)], [])[0]) == 1
    address = [block((100, 200 + 20 * i, 250, 215 + 20 * i), 1, 1.0, name=i) for i in range(3)]
    kept, counts = blocks.refine_page(address, [])
    assert [(b["cells"], b["merged_from"], b["bbox"]) for b in kept] == [(3, [0, 1, 2], (100, 200, 250, 255))] and counts["merged_count"] == 2
    nested = [block((0, 0, 400, 400), 40, 0.9, "mixed"), block((100, 100, 200, 200), 3, 0.2, "mixed", 2)]
    assert [b["block_id"] for b in blocks.refine_page(nested, [])[0]] == [1]
    # blocks without listed cells: no strong block is left to drop a weak one for
    assert len(blocks.refine_page([block(strong, 15, 0.5, "mixed"), block(weak, 3, 0.5, "mixed", 2)], [], compat=True)[0]) == 2
    assert blocks.refine_page([], []) == ([], dict.fromkeys(blocks.STAGES, 0))


def _overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return max(0, w) * max(0, h)


def _union(spans):
    points = sorted({p for s in spans for p in s})
    return sum(b - a for a, b in zip(points, points[1:], strict=False) if any(lo <= a and b <= hi for lo, hi in spans))


def _detect(boxes, seeds=(), width=612.0, height=792.0):
    """Baselines of a page by the rule: [(side, value, count, block_support, coverage, page_position)]."""
    out = []
    for side, at in (("left", 0), ("right", 2), ("top", 1), ("bottom", 3)):
        upright, groups = at % 2 == 0, defaultdict(list)
        for b, n in seeds if upright else ():
            groups[round(b[at])].append((b, max(1, min(n, 6)), True))
        for b in boxes:
            if not upright or not seeds or min(abs(b[at] - s[at]) for s, _ in seeds) <= 2:
                groups[round(b[at])].append((b, 1, False))
        for rows in groups.values():
            count = sum(w for _, w, _ in rows)
            seeded = any(x for _, _, x in rows)
            if (count < 3 or (seeds and not seeded)) if upright else len(rows) < 2:
                continue
            lo, hi = (1, 3) if upright else (0, 2)
            spans = [(b[lo], b[hi]) for b, _, x in rows if x or not seeded]
            value = sum(b[at] * w for b, w, _ in rows) / count
            extent = width if upright else height
            names = ("page_left", "page_right") if upright else ("page_top", "page_bottom")
            place = names[0] if value < extent * 0.25 else names[1] if value > extent * 0.75 else "mid_page"
            out.append({"side": side, "value": value, "count": count, "block": sum(w for _, w, x in rows if x), "spans": spans, "place": place, "coverage": round(min(1, _union(spans) / (height if upright else width)), 3)})
    upright, kept = sorted((b for b in out if b["side"] in ("left", "right")), key=lambda b: b["value"]), []
    for b in upright:
        p = kept[-1] if kept else None
        both = _union(p["spans"]) + _union(b["spans"]) - _union(p["spans"] + b["spans"]) if p else 0
        if p and p["side"] == b["side"] and b["value"] - p["value"] <= 3 and both / min(_union(p["spans"]), _union(b["spans"])) >= 0.3:
            n = p["count"] + b["count"]
            p |= {"value": (p["value"] * p["count"] + b["value"] * b["count"]) / n, "count": n, "block": p["block"] + b["block"], "spans": p["spans"] + b["spans"]}
            p["coverage"] = round(min(1, _union(p["spans"]) / height), 3)
        else:
            kept.append(dict(b))
    kept = [b for b in kept if not seeds or b["coverage"] >= 0.2 or b["place"] != "mid_page"]
    level = []
    for b in sorted((b for b in out if b["side"] in ("top", "bottom")), key=lambda b: (-b["count"], b["value"])):
        if all(abs(b["value"] - x["value"]) >= 5 for x in level):
            level.append(b)
    return kept + level


def _pages(spark, n=12, view=views.boxes):
    pages = defaultdict(list)
    for r in view(spark, SF).orderBy("page_ix", "box_id").collect():
        pages[r.page_ix].append((r.x0, r.y0, r.x1, r.y1))
    return {k: pages[k] for k in sorted(pages)[:n]}


def _told(rows):
    return sorted((b["side"], round(b["value"], 6), b["count"], b["block"], b["coverage"], b["place"]) for b in rows)


def test_baselines_without_and_with_blocks(spark):
    pages = _pages(spark, view=views.tall_boxes)
    b = views.tall_boxes(spark, SF).filter(F.col("page_ix").isin(*pages))
    first, found = baselines.detect(b, ["page_ix"]), defaultdict(list)
    seeds, seeded = defaultdict(list), defaultdict(list)
    blocked = blocks.identify(b, first, ["page_ix"])
    for r in first.collect():
        found[r.page_ix].append((r.side, round(r.value, 6), r["count"], r.block_support, r.coverage, r.page_position))
    for r in blocked.collect():
        seeds[r.page_ix].append(((r.x0, r.y0, r.x1, r.y1), r.line_count))
    for r in baselines.detect(b, ["page_ix"], blocked).collect():
        seeded[r.page_ix].append((r.side, round(r.value, 6), r["count"], r.block_support, r.coverage, r.page_position))
    assert any(seeds.values())
    for k, boxes in pages.items():
        assert sorted(found[k]) == _told(_detect(boxes))
        assert sorted(seeded[k]) == _told(_detect(boxes, seeds[k]))


def test_consistency_is_the_deviation_along_the_baseline(spark):
    rows = [(1, 50.0, y, 90.0, y + 10) for y in (0.0, 30.0, 60.0, 120.0)]
    b = spark.createDataFrame(rows, "page_ix long, x0 double, y0 double, x1 double, y1 double")
    left = baselines.judged(baselines.detect(b, ["page_ix"])).filter("side = 'left'").first()
    assert left.consistency == round(1 - statistics.pstdev([5, 35, 65, 125]) / 50, 3)
    assert left.confidence == round(0.4 * 0.4 + 0.3 * left.coverage + 0.2 * left.consistency + 0.2, 3) and left.retained and left.reasons == []
    strict = baselines.judged(baselines.detect(b, ["page_ix"]), t=baselines.Limits(min_confidence=2, min_support=9, min_consistency=0.9)).filter("side = 'left'").first()
    assert [r.split(" ")[0] for r in strict.reasons] == ["low_confidence", "low_support", "low_consistency"] and not strict.retained
    mid = spark.createDataFrame([(1, 300.0, y, 340.0, y + 10) for y in (0.0, 30.0, 60.0)], b.schema)
    found = {r.side: r for r in baselines.detect(mid, ["page_ix"], compat=True).collect()}
    assert found["right"].coverage == 0 and found["left"].coverage == 0.038


def _identify(boxes, lefts, rights):
    """Blocks of a page by the rule, over all pairs: boxes of blocks with their lines."""
    w, h = (statistics.median(max(1e-12, b[k + 2] - b[k]) for b in boxes) for k in (0, 1))

    def cells(b, of):
        mx, my = min(x[0] for x in of), min(x[1] for x in of)
        cw, ch = (statistics.median(max(1e-12, x[k + 2] - x[k]) for x in of) for k in (0, 1))
        return [int((b[0] - mx) // cw), int((b[2] - mx) // cw), int((b[1] - my) // ch), int((b[3] - my) // ch)]

    def gaps(of, main):
        other, out = 1 - main, {}
        for i, a in enumerate(of):
            for j, b in enumerate(of):
                p, q = cells(a, of), cells(b, of)
                if i < j and p[0] - 1 <= q[1] and q[0] <= p[1] + 1 and p[2] - 1 <= q[3] and q[2] <= p[3] + 1:
                    shared = max(0, min(a[other + 2], b[other + 2]) - max(a[other], b[other]))
                    narrow = min(a[other + 2] - a[other], b[other + 2] - b[other])
                    if narrow > 0 and shared >= 0.15 * narrow:
                        out[i, j] = max(0, b[main] - a[main + 2], a[main] - b[main + 2])
        return out

    def typical(n, pairs):
        near = [min((d for (i, j), d in pairs.items() if k in (i, j) and d > 0), default=None) for k in range(n)]
        near = [d for d in near if d is not None]
        return statistics.median(near) if near else 0

    def groups(n, pairs, cutoff):
        label = list(range(n))
        for _ in range(n):
            for (i, j), d in pairs.items():
                if d <= cutoff:
                    label[i] = label[j] = min(label[i], label[j])
        return [[i for i in range(n) if label[i] == k] for k in sorted(set(label))]

    def kind(b):
        left, right = (min(((abs(b[at] - v), v) for v in vs), default=(99, 0)) for at, vs in ((0, lefts), (2, rights)))
        return "left" if left[0] <= 3 else "right" if right[0] <= 3 else "center"

    pairs = gaps(boxes, 1)
    t = typical(len(boxes), pairs)
    out = []
    for cluster in groups(len(boxes), pairs, max(1.35 * t, 8) if t > 0 else 36):
        part = [boxes[i] for i in cluster]
        inner = gaps(part, 0)
        t = typical(len(part), inner)
        for column in groups(len(part), inner, 1.15 * t if t > 0 else float("inf")):
            mine = [part[i] for i in column]
            lines = []
            for b in sorted(mine, key=lambda b: (b[1] + b[3]) / 2):
                c = (b[1] + b[3]) / 2
                line = next((x for x in lines if abs(c - sum(x) / len(x)) <= 1.5), None)
                lines.append([c]) if line is None else line.append(c)
            kinds = Counter(kind(b) for b in mine)
            if len(lines) < 2 or (len(mine) > 2 and (max(kinds.values()) / len(mine) < 0.55 or statistics.pstdev(b[2] - b[0] for b in mine) > 18)):
                continue
            name, n = kinds.most_common(1)[0]
            box = [min(b[0] for b in mine), min(b[1] for b in mine), max(b[2] for b in mine), max(b[3] for b in mine)]
            for side, at, vs in (("left", 0, lefts), ("right", 2, rights)):
                near = [(abs(box[at] - v), v) for v in vs if abs(box[at] - v) <= 5]
                if name == side and n / len(mine) >= 0.6 and near:
                    box[at] = min(near)[1]
            out.append((*[round(x, 6) for x in box], len(lines), len(mine)))
    return sorted(out)


def test_blocks_by_the_rule(spark):
    pages = _pages(spark, 8, views.tall_boxes)
    b = views.tall_boxes(spark, SF).filter(F.col("page_ix").isin(*pages))
    first, got = baselines.detect(b, ["page_ix"]), defaultdict(list)
    edges = defaultdict(lambda: {"left": [], "right": []})
    for r in first.filter("side in ('left', 'right') and count >= 3").collect():
        edges[r.page_ix][r.side].append(r.value)
    for r in blocks.identify(b, first, ["page_ix"]).collect():
        got[r.page_ix].append((*[round(x, 6) for x in (r.x0, r.y0, r.x1, r.y1)], r.line_count, r.cell_count))
    assert sum(map(len, got.values())) > 5
    for k, boxes in pages.items():
        assert sorted(got[k]) == _identify(boxes, edges[k]["left"], edges[k]["right"])


def test_a_cluster_is_no_block_for_a_reason():
    boxes = lambda *w: np.array([(0, 12.0 * i, x, 12.0 * i + 16) for i, x in enumerate(w)])
    find = lambda b, kinds: blocks.find_blocks(b, kinds, [0.0] * len(b), [0.0], [])
    found, reasons = find(boxes(50, 50, 50), ["left"] * 3)
    assert [(f["line_count"], f["dominant_alignment"], f["line_spacing_mean"], f["line_spacing_mode"]) for f in found] == [(3, "left", 12.0, 12.0)] and reasons == []
    assert find(boxes(50, 50, 50, 50), ["left", "left", "right", "center"])[1] == ["orientation_variance"]
    assert find(boxes(20, 120, 20), ["left"] * 3)[1] == ["width_variance"]
    assert find(boxes(20, 120, 20, 90), ["left", "left", "right", "center"])[1] == ["orientation_and_width_variance"]
    assert find(np.array([(0, 0, 50, 10), (0, 500, 50, 510.0)]), ["left"] * 2)[1] == ["below_min_lines"] * 2


def _cells(spark, rows):
    return spark.createDataFrame([(1, i, t, *map(float, b)) for i, (t, b) in enumerate(rows)], "page_ix long, box_id long, text string, x0 double, y0 double, x1 double, y1 double")


def test_a_baseline_through_the_middle_of_a_cell(spark):
    row = [("word", (i * 60, 90, i * 60 + 40, 100)) for i in range(5)]
    hit = lambda box, more=(): [r.text for r in alignment.horizontal_anomalies(_cells(spark, [*row, ("Secret sum", box), *more]), ["page_ix"], "box_id").collect()]
    assert hit((400, 94, 460, 106)) == ["Secret sum"]
    assert hit((400, 97, 460, 109)) == []  # too near its top
    assert hit((400, 98, 460, 102)) == []  # two points from either edge
    below = [("x", (i * 60, 99, i * 60 + 9, 108.5)) for i in range(2)]
    assert hit((400, 94, 460, 106), below) == []  # the next baseline follows closely
    assert hit((400, 99, 460, 101)) == []


def test_iterative_blocks_by_the_rule(spark):
    def split(points, axis, eps):
        out = []
        for p in sorted(points, key=lambda p: (p[axis], p[2])):
            if out and p[axis] - out[-1][-1][axis] <= eps:
                out[-1].append(p)
            else:
                out.append([p])
        return out

    got = defaultdict(list)
    for r in registry.QUERIES["iterative_blocks"](spark, SF).collect():
        got[r.page_ix].append((r.cell_count, r.x0, r.y0, r.x1, r.y1))
    for k, boxes in _pages(spark).items():
        now = [[((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, i) for i, b in enumerate(boxes)]]
        for axis, eps in ((1, 12), (0, 40), (1, 12)):
            after, any_split = [], False
            for part in now:
                islands = split(part, axis, eps)
                lone, real = [x[0] for x in islands if len(x) == 1], [x for x in islands if len(x) > 1]
                after += [lone] if len(lone) > 1 else []
                after += real if len(real) > 1 else [real[0] + (lone if len(lone) == 1 else [])] if real else ([lone] if len(lone) == 1 else [])
                any_split |= len(real) > 1
            now = after
            if not any_split:
                break
        want = [(len(p), *[f(boxes[i][c] for *_, i in p) for f, c in ((min, 0), (min, 1), (max, 2), (max, 3))]) for p in now if len(p) > 1]
        assert sorted(got[k]) == sorted(want)


def test_suppression_greedy_matches_and_clips_by_the_rule(spark):
    rows = defaultdict(Counter)
    for k, boxes in _pages(spark, 40).items():
        rows[k] = Counter(round(b[3]) for b in boxes)
    got = defaultdict(set)
    for r in registry.QUERIES["baseline_suppression"](spark, SF).collect():
        got[r.page_ix].add(r.value)
    for k, c in rows.items():
        kept = []
        for y, _ in sorted(((y, n) for y, n in c.items() if n >= 2), key=lambda x: (-x[1], x[0])):
            kept += [y] if all(abs(y - z) >= 5 for z in kept) else []
        assert got[k] == set(kept)
    best, taken, want = defaultdict(list), set(), set()
    for r in registry.QUERIES["match_candidates"](spark, SF).collect():
        best[r.doc_id, r.page_ix, r.cell].append((-r.score, r.span))
    for key in sorted(best):
        free = [x for x in sorted(best[key]) if (*key[:2], x[1]) not in taken]
        if free:
            taken.add((*key[:2], free[0][1]))
            want.add((*key, free[0][1]))
    assert {(r.doc_id, r.page_ix, r.cell, r.span) for r in registry.QUERIES["greedy_match"](spark, SF).collect()} == want
    streams, told = defaultdict(list), {}
    for e in views.table(spark, SF, "events").collect():
        streams[e.user_id % 200].append((e.event_id, e.event_type))
    for events in streams.values():
        depth, at = [], False
        for i, kind in sorted(events):
            if kind == "purchase":
                depth.append(at)
            elif kind == "error":
                at = depth.pop() if depth else False
            elif kind == "click":
                at = True
            else:
                told[i] = at
    assert {r.event_id: r.has_clip for r in registry.QUERIES["clip_walk"](spark, SF).collect()} == told


def test_hidden_text_is_what_the_anti_join_leaves(spark):
    a = {(r.doc_id, r.cell_index): r.kind for r in registry.QUERIES["hidden_text"](spark, SF).collect()}
    assert set(a) == {(r.doc_id, r.cell_index) for r in registry.QUERIES["not_visible_anti_join"](spark, SF).collect()}
    assert set(a.values()) <= {"missing", "overlap"}


def test_dbscan_blocks_by_the_rule(spark):
    got = defaultdict(list)
    for r in registry.QUERIES["dbscan_blocks"](spark, SF).collect():
        got[r.page_ix].append((r.block_id, r.cell_count, r.x0, r.y1))
    for k, boxes in _pages(spark).items():
        p = [((b[0] + b[2]) / 2 * 0.2, (b[1] + b[3]) / 2) for b in boxes]
        near = [[j for j, q in enumerate(p) if (q[0] - x) ** 2 + (q[1] - y) ** 2 <= 144] for x, y in p]
        core = [len(x) >= 3 for x in near]
        label = [i if c else None for i, c in enumerate(core)]
        for _ in p:
            for i, c in enumerate(core):
                if c:
                    label[i] = min(label[j] for j in near[i] if core[j])
        for i, c in enumerate(core):
            if not c:
                label[i] = min((label[j] for j in near[i] if core[j]), default=None)
        want = [(m, sum(x == m for x in label), min(b[0] for b, x in zip(boxes, label) if x == m), max(b[3] for b, x in zip(boxes, label) if x == m)) for m in sorted({x for x in label if x is not None})]
        assert sorted(got[k]) == want


def test_blocks_of_many_pages_are_those_of_each():
    rng = np.random.default_rng(5)
    pages = []
    for n in (*range(1, 40), 300):
        low = np.stack([rng.integers(0, 12, n) * 40.0 + rng.choice([0, 0.25], n), rng.integers(0, 30, n) * 10.5 + rng.choice([0, 1.25, 3.5], n)], axis=1)
        boxes = np.concatenate([low, low + np.stack([rng.integers(0, 70, n), rng.integers(8, 20, n)], axis=1)], axis=1)
        pages.append((boxes, rng.integers(0, 3, n), np.round(rng.random(n) * 500, 2), np.sort(rng.choice(500, rng.integers(0, 9))).astype(float), rng.choice(500, 5).astype(float)))
    page = np.repeat(np.arange(len(pages)), [len(p[0]) for p in pages])
    for t in (blocks.Limits(), blocks.Limits(min_dominance=0.2, block_dominance=0.3, max_width_deviation=40.0, radius=2)):
        found = blocks.find_in_pages(page, *[np.concatenate([p[k] for p in pages]) for k in range(3)], [p[3] for p in pages], [p[4] for p in pages], t)
        told = [{c: found[c][k] for c in found} for k in range(len(found["page"]))]
        plain = [{"page": k} | b for k, (box, kind, value, *sides) in enumerate(pages) for b in blocks.find_blocks(box, [blocks.KINDS[x] for x in kind], value.tolist(), *[x.tolist() for x in sides], t)[0]]
        assert len(plain) > 50 and told == plain


def test_a_page_with_an_unknown_side_leaves_the_others_whole(spark):
    b = views.tall_boxes(spark, SF).filter("page_ix < 6").cache()
    first = baselines.detect(b, ["page_ix"])
    odd = b.unionByName(b.filter("page_ix = 2").limit(1).withColumn("box_id", F.lit(100000).cast("long")).withColumn("y1", F.lit(None).cast("double")))
    whole, others = ({tuple(r[:6]) for r in blocks.identify(x, first, ["page_ix"]).filter("page_ix != 2").collect()} for x in (b, odd))
    assert whole and whole == others


def test_chains_of_many_pages_are_those_of_each(spark):
    rows = [(p, k, 40.0 + x, 10.0 * k, 40.0 + x + w, 10.0 * k + 8) for p in range(30) for k, (x, w) in enumerate(((k * (p + 3)) % 7 * 2.25, 30 + k * p % 3 * 1.5) for k in range(40))]
    cells, got = spark.createDataFrame(rows, "page_ix long, box_id long, x0 double, y0 double, x1 double, y1 double"), defaultdict(list)
    for r in baselines.detect(cells, ["page_ix"]).collect():
        got[r.page_ix].append((r.side, round(r.value, 6), r["count"], r.block_support, r.coverage, r.page_position))
    for p in range(30):
        assert sorted(got[p]) == _told(_detect([r[2:] for r in rows if r[0] == p]))


def test_blocks_are_assigned_page_by_page_in_any_order_of_rows(spark):
    rows = [(p, k, "t", *(float(x) for x in (k * p % 5 * 60, k * 7 % 90, k * p % 5 * 60 + 20, k * 7 % 90 + 8)), 1 if k % 3 else None, k % 2) for p in range(1, 20) for k in range(p + 3)]
    schema = "page_ix long, box_id long, text string, x0 double, y0 double, x1 double, y1 double, table_id int, column_id int"
    for compat in (False, True):
        got = defaultdict(list)
        for r in alignment.assign_blocks(spark.createDataFrame(rows[::-1], schema).repartition(5), ["page_ix"], "box_id", compat=compat).collect():
            assert (r.page_ix, r.box_id, r.text, r.x0, r.y0, r.x1, r.y1, r.table_id, r.column_id) in rows
            got[r.page_ix].append((r.block_id, r.box_id))
        for p in range(1, 20):
            mine = [r for r in rows if r[0] == p]
            centre = lambda a: np.array([(r[a] + r[a + 2]) / 2 for r in mine])
            want = kernels.split_iteratively(centre(3), centre(4), compat=compat, columns=[None if r[7] is None else (r[7], r[8]) for r in mine])
            assert sorted(got[p]) == sorted((k, mine[i][1]) for k, b in enumerate(want) for i in b)


def test_alignment_of_a_block_takes_no_window(spark):
    rows = [(1, 0, 10.0, 50.0), (1, 0, 10.4, 61.0), (1, 0, 30.0, 72.0), (1, 0, 12.0, 90.0), (1, 1, 7.0, 40.0), (1, 1, 3.0, 40.0), (1, 2, None, 40.0), (1, 2, None, 80.0), (1, 2, 5.0, 99.0), (1, 3, -0.4, 20.0), (1, 3, 0.3, 20.0), (1, 3, 9.0, 70.0)]
    cells = spark.createDataFrame([(p, b, k, x0, 0.0, x1, 9.0) for k, (p, b, x0, x1) in enumerate(rows)], "page_ix long, block_id long, box_id long, x0 double, y0 double, x1 double, y1 double")
    found = alignment.block_alignment(cells, ["page_ix"], "box_id")
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    told = {r.block_id: (r.cells, r.alignment, r.baseline, r.confidence) for r in found.collect()}
    assert told == {0: (4, "left", 10.0, 0.75), 1: (2, "right", 40.0, 1.0), 2: (3, "mixed", None, 0.0), 3: (3, "mixed", None, 0.0)}


def test_refinement_of_many_pages_is_that_of_each(spark):
    rows = [(p, k, 40.0, 20.0 * k + p % 3, 90.0 + k * p % 7, 20.0 * k + 12, 1 + k * p % 9, ("left", "right", "mixed")[k * p % 4 % 3], 0.5 + 0.1 * (k % 5)) for p in range(25) for k in range(p % 8 + 1)]
    tables = spark.createDataFrame([(p, 1, 30.0, 0.0, 100.0, 60.0) for p in range(0, 25, 2)], "page_ix long, table_id int, tx0 double, ty0 double, tx1 double, ty1 double")
    found = blocks.refine(spark.createDataFrame(rows[::-1], "page_ix long, block_id long, x0 double, y0 double, x1 double, y1 double, cells long, alignment string, share double"), tables, ["page_ix"])
    want = []
    for p in range(25):
        page, counts = blocks.refine_page([block(r[2:6], r[6], r[8], r[7], r[1]) for r in rows if r[0] == p], [] if p % 2 else [(30.0, 0.0, 100.0, 60.0)])
        want += [(p, b["block_id"], *b["bbox"], b["cells"], b["alignment"], b["share"], b["confidence"], b["merged_from"], counts) for b in page]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
