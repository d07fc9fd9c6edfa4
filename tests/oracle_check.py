"""Compare registered queries with their oracle SQL: python -m tests.oracle_check [sf_dir] [name ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, fn, sql):
    """(ok, detail)"""
    t0 = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"rows={len(got)} spark={t1 - t0:.1f}s (no oracle)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    took = f"rows={len(got)} spark={t1 - t0:.1f}s duckdb={t2 - t1:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"{took} columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if kinds.get(t, types[c]) != types[c]]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{took} want_rows={len(b)} cols={sorted(names)} diff={bad}"
    note = f" TYPES {odd}" if odd else ""
    if not got:
        note += " EMPTY"
    return True, took + note


def main(argv):
    folder = "/root/testdata/sf0.01"
    if argv and os.path.isdir(argv[0]):
        folder, argv = argv[0], argv[1:]
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pagelens.session import local_session, release

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    q, o = entry.queries(), entry.oracle_sql()
    names = [n for n in q if not argv or n in argv or any(a.endswith("*") and n.startswith(a[:-1]) for a in argv)]
    failed = 0
    for n in names:
        try:
            ok, detail = compare(spark, con, folder, q[n], o.get(n))
        except Exception as e:  # noqa: BLE001 - keep going, report at the end
            ok, detail = False, f"{type(e).__name__}: {str(e)[:700]}"
        release(spark)
        failed += not ok
        print(("ok   " if ok else "FAIL ") + f"{n:24s} {detail}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
