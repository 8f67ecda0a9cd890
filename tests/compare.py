"""Run registered queries against their SQL in DuckDB: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_plain(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def check(spark, con, sf_dir, fn, sql):
    """(ok, message)"""
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got == want:
        return True, f"{len(got)} rows"
    from collections import Counter
    a, b = Counter(got), Counter(want)
    only, lack = list((a - b).elements()), list((b - a).elements())
    return False, (f"rows {len(got)} vs {len(want)}; only in Spark {len(only)}, only in SQL {len(lack)}; {got_cols}; "
                   f"{sorted(only)[:2]} / {sorted(lack)[:2]}")


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from hindcast.session import local_session
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(cores="8"), duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for name in (args or qs):
        t = time.time()
        try:
            if name in os_:
                ok, msg = check(spark, con, sf_dir, qs[name], os_[name])
            else:
                ok, msg = True, f"{qs[name](spark, sf_dir).count()} rows only"
        except Exception as exc:  # report and go on
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg[:900]}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
