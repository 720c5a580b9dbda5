"""Versions of results against a plain reading of the rule."""

import random

from folioscan.operators import kernels, versions


def test_versions_equal_all_pairs(spark):
    rng = random.Random(4)
    box = lambda: [rng.choice([0.0, 1.0, 2.5, 4.0, 7.9, 8.0, 30.0]) for _ in range(2)]
    make = lambda n: [(p, i, *(b := box()), b[0] + 5.0, b[1] + 5.0, rng.choice(["a", "b", None]), rng.choice([1, None])) for p in range(4) for i in range(n)]
    old, new = make(15), make(13) + [(7, 0, 1.0, 1.0, 6.0, 6.0, "only new", 1)]
    schema = "page_ix long, box_id int, x0 double, y0 double, x1 double, y1 double, text string, n int"
    want = set()
    for p in (0, 1, 2, 3, 7):
        a, b = {r[1]: r for r in old if r[0] == p}, {r[1]: r for r in new if r[0] == p}
        off = lambda r, s: max(abs(x - y) for x, y in zip(r[2:6], s[2:6], strict=True))
        pairs = kernels.greedy_match([(i, j, 1 / (1 + off(r, s))) for i, r in a.items() for j, s in b.items() if off(r, s) <= 2.0])
        for i, j, s in pairs:
            changed = tuple(c for c, x, y in zip(("text", "n"), a[i][6:], b[j][6:], strict=True) if x != y)
            want.add((p, i, j, "changed" if changed else "same", changed, round(1 / s - 1, 6)))
        want |= {(p, i, None, "lost", None, None) for i in a.keys() - {x[0] for x in pairs}} | {(p, None, j, "added", None, None) for j in b.keys() - {x[1] for x in pairs}}
    found = versions.compare(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["page_ix"], "box_id", ["text", "n"])
    got = {(r.page_ix, r.old, r.new, r.status, None if r.changed is None else tuple(r.changed), None if r.moved is None else round(r.moved, 6)) for r in found.collect()}
    assert got == want
    assert {r.page_ix: (r.same + r.changed + r.lost, r.added) for r in versions.summary(found, ["page_ix"]).collect()}[7] == (0, 1)
