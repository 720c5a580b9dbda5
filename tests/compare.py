"""Runs queries beside their SQL in DuckDB: python tests/compare.py [NAME...] (default: all with SQL) at sf0.01."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, dict):
        return tuple(canonical(v[k]) for k in sorted(v))
    if hasattr(v, "asDict"):
        return canonical(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    return v


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if both give the same columns and rows."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    ours = sorted((tuple(canonical(r[c]) for c in names) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in names]
    theirs = sorted((tuple(canonical(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if ours == theirs:
        return None
    a, b = set(ours), set(theirs)
    return f"{len(ours)} and {len(theirs)} rows; {names}; only here {sorted(a - b, key=repr)[:3]}; only in SQL {sorted(b - a, key=repr)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from tests.conftest import session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con, bad = session(), connect(sf_dir), 0
    for name in sys.argv[1:] or sorted(e.oracle_sql()):
        t = time.time()
        try:
            said = difference(spark, con, e.queries()[name], e.oracle_sql()[name], sf_dir)
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:900]}"
        bad += said is not None
        print(name, "ok" if said is None else f"DIFFERS {said}", f"{time.time() - t:.1f} s", flush=True)
    print("differing:", bad)
