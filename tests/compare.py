"""Compare registered queries with their SQL twins in DuckDB.

Run as a script: ``python tests/compare.py [--sf DIR] [name-prefix ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        return "~" if math.isnan(v) else repr(v + 0.0)
    return f"{type(v).__name__}:{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows-only ({len(got)} rows)", len(got) > 0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}", False
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return f"ok ({len(a)} rows)", len(a) > 0
    extra = [r for r in a if r not in set(b)][:3]
    missing = [r for r in b if r not in set(a)][:3]
    return f"DIFF rows {len(a)} vs {len(b)}\n   spark {extra}\n   duck  {missing}\n   cols {sorted(names)}", False


def main(argv):
    from sondage.session import local_session
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        folder = argv[at + 1]
        argv = argv[:at] + argv[at + 2:]
    spark = local_session(8)
    con = duck(folder)
    bad = []
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            text, ok = compare(spark, con, name, fn, oracles.get(name), folder)
        except Exception as e:  # report and go on
            text, ok = f"ERROR {type(e).__name__}: {str(e)[:900]}", False
        print(f"{'  ' if ok else '!!'} {name} {time.time() - start:.1f}s {text}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
