"""Run catalogue queries in Spark and their SQL in DuckDB and compare all values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x).__name__), str(x)) for x in r))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None or isinstance(a, str) or isinstance(b, str):
            return a == b
        return a == b
    return a == b


def compare(con, spark, fn, sql, folder):
    df = fn(spark, folder)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    onames, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != onames:
        return f"columns {names} vs {onames}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not all(same(x, y) for x, y in zip(g, w))]
    if bad:
        g, w = bad[0]
        cols = [(n, repr(x)[:160], repr(y)[:160]) for n, x, y in zip(names, g, w) if not same(x, y)]
        return f"{len(bad)} of {len(got)} rows differ, e.g. {cols}"
    types = [(n, type(x).__name__, type(y).__name__) for n, x, y in zip(names, got[0], want[0]) if type(x) is not type(y) and x is not None and y is not None] if got else []
    return f"types {types}" if types else None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from scoutmill.session import discard_kept, local_session

    folder = sys.argv[1]
    only = set(sys.argv[2:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = duck(folder)
    sql = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if only and name not in only and not any(o.endswith("*") and name.startswith(o[:-1]) for o in only):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(con, spark, fn, sql[name], folder)
            else:
                n = len(fn(spark, folder).collect())
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        took = time.time() - start
        if problem:
            failed += 1
            print(f"FAIL {name} ({took:.1f}s): {problem}", flush=True)
        elif only or took > 3:
            print(f"ok   {name} ({took:.1f}s){'' if name in sql else ' rows only'}", flush=True)
    discard_kept(spark)
    print("failed", failed, "of", len(entry.queries()), "with sql", len(sql))
