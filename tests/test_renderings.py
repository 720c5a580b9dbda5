"""Two renderings as compressed pages: what is put in comes out, texts compare as in Spark, queries read their documents once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from folioscan.functions import text as tx
from folioscan.operators import kernels, matching, pages, renderings
from folioscan.plans import q_text, views

SF = "/root/testdata/sf0.001"


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("name, shuffles", [("not_visible_anti_join", 1), ("match_outcome", 2), ("match_statistics", 2), ("hidden_text", 2), ("closest_visible", 1), ("match_candidates", 1), ("greedy_match", 1), ("visible_semi_join", 1)])
def test_renderings_come_from_one_scan(spark, name, shuffles):
    """Both sides from one reading, cells as pages of bytes before they are shuffled; greedy pages are not shuffled again."""
    df = e.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert scans(df) == 1 and plan.count("Exchange hashpartitioning") == shuffles and "levenshtein" not in plan


@pytest.mark.parametrize("ident", [pa.array([5, 2**62, -7, 3]), pa.array([5, None, 1, 3]), pa.array(["a", "é", None, "b"])])
def test_pages_come_out_as_they_went_in(ident):
    texts = [pa.array(["né", None, "", "x"]), pa.array([None, "A", "b", None])]
    for boxes in ([[0, 12, 6, 22], [6, 12, 2**50, 22], [-3, 0, -9, 1], [1, 2, 3, 4]], [[0.1, 12, 6, 22], [np.nan, 1e300, -np.inf, 0.3], [-3, 0, -9, 1], [1, 2, 3, 4]]):
        boxes = np.array(boxes, float)
        side = renderings.decoded(renderings.encoded(np.array([0, 3, 4]), ident, boxes, texts), np.array([4, 9]), 2, ident.type)
        assert side.ident.equals(ident) and [t.equals(u) for t, u in zip(side.texts, texts, strict=True)] == [True, True]
        assert np.array_equal(side.boxes, boxes, equal_nan=True) and side.piece.tolist() == [4, 4, 4, 9]
    assert len(renderings.decoded([], np.zeros(0, np.int64), 1, pa.int64()).boxes) == 0


def test_texts_are_as_alike_as_in_spark(spark):
    """Short and long texts, of several words, outside the plain of sixteen bits."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé𝄞") for _ in range(rng.choice([1, 2, 3, 5, 9, 31, 32, 33, 70])))
    a = [word() for _ in range(120)]
    b = [x if rng.random() < 0.2 else " ".join([x[:-1] + "z", word()]) if rng.random() < 0.3 else word() if rng.random() < 0.5 else x[1:] + "q" for x in a]
    df = spark.createDataFrame(list(zip(range(120), a, b, strict=True)), "k long, a string, b string")
    t = renderings.Texts(pa.array(a), pa.array(b))
    for phrase in (False, True):
        want = [r.s for r in df.select("k", tx.token_similarity(F.col("a"), F.col("b"), phrase).alias("s")).orderBy("k").collect()]
        assert t.token_similarity(t.a, t.b, phrase).tolist() == want
        high = np.array(want) >= 0.6
        got = t.token_similarity(t.a, t.b, phrase, 0.6)
        assert got[high].tolist() == np.array(want)[high].tolist() and (got[~high] < 0.6).all()
    assert t.similarity(t.a, t.b).tolist() == [r.s for r in df.select("k", tx.levenshtein_similarity(F.col("a"), F.col("b")).alias("s")).orderBy("k").collect()]


def test_views_give_the_pages_of_their_rows(spark, monkeypatch):
    """Compressed pages of documents are those of the tables of cells, in small shares as well."""
    monkeypatch.setattr(views, "_TEXT", 2000)
    c, v = q_text._cells(views.cells(spark, SF)), q_text._cells(views.visible(spark, SF))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(matching.find_visible(c, v, "word")) == rows(matching.seen(views.renderings(spark, SF, "normal"), "word"))
    assert rows(matching.unseen(c, v, "word")) == rows(matching.lacking(views.renderings(spark, SF, "normal", raw=True), "word"))
    found = matching.candidates(c, v)
    assert rows(found) == rows(matching.pairs(views.renderings(spark, SF, "lower")))
    assert rows(matching.match_statistics(c, found)) == rows(matching.statistics_of(views.renderings(spark, SF, "lower")))
    won = matching.match(c, v)
    assert rows(won.select("doc_id", "page_ix", "cell", "span", "score")) == rows(matching.greedy(found))
    assert rows(matching.outcome_counts(c, v, won)) == rows(matching.outcome_of(views.renderings(spark, SF, "lower")))


def test_pairs_that_share_a_cell_or_span_go_in_order():
    rng = np.random.default_rng(8)
    page, cell, span = rng.integers(0, 20, 300), rng.integers(0, 30, 300), rng.integers(0, 30, 300)
    score = rng.integers(1, 5, 300) / 4
    _, once = np.unique(np.stack([page, cell, span]), axis=1, return_index=True)
    page, cell, span, score = (x[once] for x in (page, cell, span, score))
    k = matching._free(page, cell, span, score)
    want = {(p, *m) for p in set(page.tolist()) for m in kernels.greedy_match([r[1:] for r in zip(page.tolist(), cell.tolist(), span.tolist(), score.tolist(), strict=True) if r[0] == p])}
    assert set(zip(page[k].tolist(), cell[k].tolist(), span[k].tolist(), score[k].tolist(), strict=True)) == want


def test_boxes_with_crossed_sides_meet_once():
    """Such a box lies in bins before the one in which it begins."""
    rng = np.random.default_rng(9)
    a, b = (np.concatenate([x, x + rng.integers(-90, 120, (60, 2))], axis=1) for x in rng.integers(-100, 300, (2, 60, 2)).astype(float))
    want = [(i, j) for i in range(60) for j in range(60) if (a[i, :2] < b[j, 2:]).all() and (b[j, :2] < a[i, 2:]).all()]
    near = {(i, j) for i, j in want if (a[i, :2] <= a[i, 2:]).all() and (b[j, :2] <= b[j, 2:]).all()}
    got = list(zip(*(x.tolist() for x in pages.meeting(a, b)), strict=True))
    assert len(got) == len(set(got)) and set(got) <= set(want) and near <= set(got) and near
