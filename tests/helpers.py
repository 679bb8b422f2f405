"""Compare a Spark query with its SQL in DuckDB over one folder of tables."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if hasattr(v, "isoformat"):
        return (v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v).isoformat()
    if type(v).__name__ == "Decimal":
        return plain(float(v)) if v % 1 else int(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in data))


def assert_same(spark, query, sql, sf=SF):
    df = query(spark, sf)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = rows(names, got.fetchall())
    assert sorted(df.columns) == sorted(names)
    have = rows(df.columns, df.collect())
    assert len(have) == len(want), (len(have), len(want))
    bad = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(have)
