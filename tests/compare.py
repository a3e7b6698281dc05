"""Run registered queries beside their SQL in DuckDB and report differences.

    python -m tests.compare [sf_dir] [name-pattern ...]
"""

from __future__ import annotations

import re
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    import datetime as dt
    import math

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(con, df, sql: str) -> str | None:
    """None when equal, else a short description."""
    cols = sorted(df.columns)
    mine = Counter(tuple(_key(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    pos = [names.index(c) for c in cols]
    theirs = Counter(tuple(_key(r[i]) for i in pos) for r in cur.fetchall())
    if mine == theirs:
        return None
    a, b = mine - theirs, theirs - mine
    return (
        f"rows {sum(mine.values())} vs {sum(theirs.values())}; only spark {sum(a.values())}, only sql {sum(b.values())}\n"
        f"   cols  {cols}\n   spark {sorted(a)[:3]}\n   sql   {sorted(b)[:3]}"
    )


def main(argv):
    import __spark_entry__ as entry
    from voltlane.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    spark = local_session()
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(re.match(p, name) for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            diff = compare(con, df, sql[name]) if name in sql else f"no sql, {df.count()} rows"
            n = ""
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        ok = diff is None
        bad += not ok and name in sql
        print(f"{'ok  ' if ok else 'DIFF'} {name} {time.time() - start:.1f}s {'' if ok else diff}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
