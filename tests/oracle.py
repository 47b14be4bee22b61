"""Compare a query with its SQL: same columns, same rows in any order (floats to 6 digits)."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(spark, sf_dir, query, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = query(spark, sf_dir)
    got = df.collect()
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert a == b
