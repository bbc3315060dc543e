"""Comparison of a query with its SQL on one of the driver's folders."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    fix = lambda v: (round(v, 6) + 0.0 if math.isfinite(v) else repr(v)) if isinstance(v, float) else v
    return sorted((tuple(fix(r[k]) for k in order) for r in rows), key=repr)


def differs(spark, query, sql: str, sf_dir: str = SMALL) -> str:
    df = query(spark, sf_dir)
    ours = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    theirs = canonical(cur.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    a = [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in ours]
    b = [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in theirs]
    return "" if sorted(a, key=repr) == sorted(b, key=repr) else f"{len(a)} and {len(b)} rows, such as {[x for x in a if x not in set(b)][:2]} and {[x for x in b if x not in set(a)][:2]}"
