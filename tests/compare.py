"""Run registered queries against their SQL twins in DuckDB.

    python tests/compare.py [--sf 0.01] [name prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    import datetime
    import decimal

    if v is None:
        return (0, "")
    if isinstance(v, float):
        if v != v:
            return (0, "")
        return (1, repr(v + 0.0 if v else 0.0))
    if isinstance(v, decimal.Decimal):
        return (1, repr(float(v)))
    if isinstance(v, bool):
        return (2, str(v))
    if isinstance(v, int):
        return (3, str(v))
    if isinstance(v, datetime.datetime):
        return (4, v.replace(tzinfo=None).isoformat())
    return (5, str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, fn, sql: str | None):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got) > 0, f"rows={len(got)} (no twin)"
    rel = con.sql(sql)
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return False, f"rows {len(got)} vs {len(want)}\n    spark {a}\n    sql   {b}"
    return len(got) > 0, f"rows={len(got)}"


def main() -> int:
    import __spark_entry__ as entry
    from touchstone.session import local_session

    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session("8"), connect(sf_dir)
    sqls, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as e:  # one failing query must not hide the others
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - t:6.2f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
