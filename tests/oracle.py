"""Runs a registered query beside its SQL and compares rows as bags."""

import math
import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cell(x):
    if x is None:
        return None
    if isinstance(x, float):
        return "nan" if math.isnan(x) else int(x) if math.isfinite(x) and x == int(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(cell(v) for v in x)
    return x


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(repr(cell(r[k])) for k in order) for r in rows)


def compare(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    df = query(spark, SF)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert bag([tuple(r) for r in df.collect()], df.columns) == bag(cur.fetchall(), names)
