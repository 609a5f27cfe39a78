"""Compare a query with its SQL on the same Parquet files."""

import glob
import math
import os

import duckdb


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def differences(spark_df, sql, folder, limit=5):
    """A description of what differs, None when nothing does."""
    cur = duck(folder).execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    rows = spark_df.collect()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns: {sorted(spark_df.columns)} against {sorted(names)}"
    order = sorted(names)
    a = sorted((tuple(_norm(r[c]) for c in order) for r in rows), key=repr)
    b = sorted((tuple(_norm(r[names.index(c)]) for c in order) for r in want), key=repr)
    kinds_a = [type(x).__name__ for x in a[0]] if a else []
    kinds_b = [type(x).__name__ for x in b[0]] if b else []
    if len(a) != len(b):
        only = [x for x in a if x not in set(b)][:limit], [x for x in b if x not in set(a)][:limit]
        return f"{len(a)} rows against {len(b)}; {order}; only here {only[0]}; only there {only[1]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ; {order}: {bad[:limit]}"
    if not a:
        return "no rows"
    if any(x != y and "NoneType" not in (x, y) for x, y in zip(kinds_a, kinds_b)):
        return f"types {kinds_a} against {kinds_b}"
    return None
