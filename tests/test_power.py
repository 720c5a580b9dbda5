"""The power transform of all documents beside the kernel for one document."""

import numpy as np

from folioscan.operators import outliers, power


def test_powers_and_scores_equal_the_kernels(spark, tmp_path):
    rng = np.random.default_rng(5)
    docs = {1: np.stack([rng.lognormal(0, 1, 150), rng.normal(0, 2, 150), -rng.exponential(1, 150), np.full(150, 3.0), rng.uniform(-1, 5, 150)], 1), 2: rng.gamma(2, 2, (60, 5)), 3: np.ones((2, 5))}
    rows = [(d, i, v.tolist()) for d, x in docs.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "doc long, id long, x array<double>").repartition(4)
    model = power.fit(df)
    powers = {r.doc: r.powers for r in model.table.collect()}
    for d in (1, 2):
        assert np.allclose(powers[d], outliers.yeo_johnson(docs[d])[1], atol=1e-4)
    model.save(str(tmp_path / "m"))
    got = {(r.doc, r.id): r.x for r in power.PowerModel.load(spark, str(tmp_path / "m")).transform(df).collect()}
    for d, x in docs.items():
        assert np.allclose(np.array([got[d, i] for i in range(len(x))]), outliers.transformed_scores(x), atol=1e-3)
    assert len(got) == len(rows) and power.fit(df.limit(0)).table.count() == 0


def test_null_numbers_stay_null(spark):
    df = spark.createDataFrame([(1, i, [float(i * i), None if i == 3 else 1.0 * i]) for i in range(9)], "doc long, id long, x array<double>")
    got = {r.id: r.x for r in power.fit(df).transform(df).collect()}
    assert got[3][1] is None and got[3][0] is not None and all(v is not None for i, x in got.items() if i != 3 for v in x)
