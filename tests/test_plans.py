"""Queries against DuckDB at the smallest scale, queries without SQL by their rows, and the plans of the main joins."""

import pytest

from folioscan.functions import geometry as g
from folioscan.plans import registry, views
from tests.compare import connect, difference

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert difference(spark, con, registry.QUERIES[name], registry.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_outlier_kernels_read_the_whole_vector(spark, tmp_path):
    rows = [(i, i % 2, [0.5] * 8 + [float(i == 7)] * 56) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    scores = {r.id: r.score for r in registry.QUERIES["isolation_scores"](spark, str(tmp_path)).collect()}
    assert max(scores, key=scores.get) == 7 and scores[7] > scores[0]
    assert {len(r.y) for r in registry.QUERIES["yeo_johnson"](spark, SF).collect()} == {64}


def test_votes_do_not_hang_on_the_scale_of_a_feature(spark, tmp_path):
    import random

    rng, flags = random.Random(6), []
    x = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    x[7] = [9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 0.0]
    for scale in (1.0, 1e5):
        rows = [(i, 0, [*v[:7], v[7] * scale]) for i, v in enumerate(x)]
        spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").write.parquet(f"{tmp_path}/{scale}/embeddings.parquet")
        flags.append({r.id for r in registry.QUERIES["ensemble_vote"](spark, f"{tmp_path}/{scale}").collect() if r.is_anomaly})
    assert 7 in flags[0] and 7 in flags[1]


def test_exact_containment_equals_the_join_here(spark):
    a = {tuple(r) for r in registry.QUERIES["containment_consolidate"](spark, SF).collect()}
    assert a == {tuple(r) for r in registry.QUERIES["containment_consolidate_exact"](spark, SF).collect()}


def test_scan_reads_only_the_columns_of_the_view(spark):
    plan = views.boxes(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_tax" not in plan


def test_geometry_cases(spark):
    rows = [((0, 0, 10, 10), (0, 0, 10, 10), 1.0, 1.0), ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3, 0.5), ((0, 0, 1, 1), (1, 0, 2, 1), 0.0, 0.0), ((0, 0, 10, 10), (2, 2, 4, 4), 0.04, 1.0), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0, 0.0)]
    df = spark.createDataFrame([tuple(float(x) for x in a + b) for a, b, _, _ in rows], ", ".join(f"{c}{s} double" for s in ("_a", "_b") for c in ("x0", "y0", "x1", "y1")))
    a, b = g.box(suffix="_a"), g.box(suffix="_b")
    got = df.select(g.iou(a, b).alias("i"), g.overlap_score(a, b, "min").alias("m")).collect()
    for r, (_, _, iou, least) in zip(got, rows, strict=True):
        assert r.i == pytest.approx(iou) and r.m == pytest.approx(least)


def test_text_functions(spark):
    from pyspark.sql import functions as F

    from folioscan.functions import text as tx

    ops = spark.createDataFrame([("Tj", ["a"]), ("'", ["b"]), ('"', ["0", "0", "c"]), ("TJ", ["d", "-20.5", "e"]), ("re", ["1"])], "op string, operands array<string>")
    assert [r.t for r in ops.select(tx.shown_text(F.col("op"), F.col("operands")).alias("t")).collect()] == ["a", "b", "c", "de", None]
    texts = spark.createDataFrame([("A  b  C",), ("",)], "t string")
    assert [r.t for r in texts.select(tx.normalize_clip(F.col("t")).alias("t")).collect()] == ["A b C", ""]
    pair = spark.createDataFrame([("", ""), ("", "ab"), ("ab", "ab")], "a string, b string")
    assert [r.s for r in pair.select(tx.levenshtein_ratio(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, 0.0, 1.0]
    packed = spark.createDataFrame([(0x102030,)], "c int").select(*[c.alias(n) for c, n in zip(g.unpack_color(F.col("c")), "rgb", strict=True)]).first()
    assert tuple(packed) == (16, 32, 48)
