"""A store of results: a second run computes nothing, a changed payload only itself, a run that died is repeated."""

import pytest
from pyspark.sql import functions as F

from folioscan.operators import results


def test_runs_go_on_from_what_is_stored(spark, tmp_path):
    path, seen = str(tmp_path / "store"), []

    def compute(todo):
        seen.append(sorted((r.doc_id or 0) for r in todo.collect()))
        return todo.filter("v > 0").select("doc_id", "fingerprint", (F.col("v") * 2).alias("twice"))

    rows = lambda *x: spark.createDataFrame(x, "doc_id long, v long")
    docs = rows((1, 5), (2, 0), (3, 7), (3, 7), (None, 4))
    assert results.current(docs, {}, path) is None
    assert results.resume(docs, {"k": 1}, compute, path) == 4 and results.resume(docs, {"k": 1}, compute, path) == 0
    assert seen == [[0, 1, 2, 3]]
    read = lambda d, p: sorted(((r.doc_id or 0), r.twice) for r in results.current(d, p, path).collect())
    assert read(docs, {"k": 1}) == [(0, 8), (1, 10), (3, 14)]
    new = rows((1, 6), (2, 0), (3, 7), (None, 4))
    assert results.resume(new, {"k": 1}, compute, path) == 1 and seen[-1] == [1] and read(new, {"k": 1}) == [(0, 8), (1, 12), (3, 14)] and read(docs, {"k": 1}) == [(0, 8), (1, 10), (3, 14)]
    assert results.resume(new, {"k": 2}, compute, path) == 4 and read(new, {"k": 2}) == [(0, 8), (1, 12), (3, 14)]
    assert results.resume(new.limit(0), {"k": 1}, compute, path) == 0
    results.vacuum(new, {"k": 2}, path, str(tmp_path / "small"))
    assert results.resume(new, {"k": 2}, compute, str(tmp_path / "small")) == 0 and spark.read.parquet(str(tmp_path / "small" / "rows")).count() == 3


def test_a_run_that_died_leaves_nothing_to_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([(i, i) for i in range(5)], "doc_id long, v long")
    compute = lambda todo: todo.select("doc_id", "fingerprint", "v")
    write = results._write

    def dies(rows, to):
        if to.endswith("done"):
            raise RuntimeError("lost")
        write(rows, to)

    monkeypatch.setattr(results, "_write", dies)
    with pytest.raises(RuntimeError):
        results.resume(docs, {}, compute, path)
    monkeypatch.setattr(results, "_write", write)
    more = docs.union(spark.createDataFrame([(9, 9)], docs.schema))
    assert results.resume(more, {}, compute, path) == 6 and results.current(more, {}, path).count() == 6 and spark.read.parquet(f"{path}/rows").count() == 11
