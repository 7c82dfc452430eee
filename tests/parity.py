"""Compare registered queries with their SQL on the given tables: ``python -m tests.parity [key ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.01")


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return float(f"{float(x):.9g}")
    return str(x)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


def duck(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir: str = SF_DIR):
    """Empty string when equal, otherwise what differs."""
    df = fn(spark, sf_dir)
    got_c, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    want_c, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_c != want_c:
        return f"columns {got_c} vs {want_c}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}: {got[:2]} | {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} differ: {bad[:2]}" if bad else ""


def main(keys):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from vigilflow.session import get_session

    spark = get_session("parity", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = duck(), entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not keys or any(n == k or (k.endswith("*") and n.startswith(k[:-1])) for k in keys)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            msg = compare(spark, con, n, queries[n], oracles.get(n))
        except Exception as exc:  # report and go on
            msg = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(msg)
        print(f"{'ok  ' if not msg else 'FAIL'} {n:28s} {'S' if n in oracles else 'R'} {time.time() - t:6.2f}s {msg}",
              flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
