"""Run registered queries against DuckDB and compare row counts, columns and values."""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, Decimal):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return repr(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, q, sf_dir: str):
    """Return (ok, message) for one query."""
    t0 = time.time()
    df = q(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if q.sql is None:
        return True, f"rows-only n={len(rows)} spark={t1 - t0:.1f}s"
    res = con.execute(q.sql)
    names = [d[0] for d in res.description]
    kinds = [str(d[1]) for d in res.description]
    want = res.fetchall()
    t2 = time.time()
    a, b = table(df.columns, rows), table(names, want)
    info = f"n={len(rows)}/{len(want)} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s"
    if a[0] != b[0]:
        return False, f"columns {a[0]} != {b[0]} {info}"
    types = dict(df.dtypes)
    for n, k in zip(names, kinds):
        s = types[n]
        good = {"bigint": "NUMBER", "int": "NUMBER", "double": "NUMBER", "string": "STRING", "boolean": "bool"}
        if k in ("HUGEINT", "INTEGER") and s != "int" or (k == "BIGINT" and s != "bigint") or (
            k == "DOUBLE" and s != "double") or k.startswith("DECIMAL"):
            return False, f"type of {n}: {s} vs {k} {info}"
    if a[1] != b[1]:
        bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y][:2]
        return False, f"values differ {info} {bad}"[:1500]
    return len(rows) > 0, info


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from strandframe.plans import QUERIES
    from strandframe.session import local_session

    sf = "/root/testdata/sf" + sys.argv[1]
    names = sys.argv[2:]
    spark, con = local_session(8), connect(sf)
    for name, q in QUERIES.items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) or n in q.build.__module__ for n in names):
            continue
        try:
            ok, msg = compare(spark, con, q, sf)
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:900]}"
        print("OK  " if ok else "FAIL", name, msg, flush=True)
