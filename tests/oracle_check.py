"""Compare registered Spark queries with their DuckDB oracle SQL.

Row count, column names and an order-insensitive hash of the values (columns
sorted by name, rows sorted, doubles printed with 6 decimals).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"  # pandas turns SQL NULL doubles into NaN
        return f"{v:.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ in ("date", "Timestamp", "datetime") else v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def digest(pdf):
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf[cols].to_dict("records"))
    return cols, len(rows), hashlib.md5("\n".join(rows).encode()).hexdigest(), rows


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sp = fn(spark, sf_dir).toPandas()
    ts = time.time() - t
    t = time.time()
    dk = con.execute(sql).df()
    td = time.time() - t
    for c in dk.columns.intersection(sp.columns):   # pandas turns integers with NULLs into floats on one side
        if str(dk[c].dtype) == "Int64" and sp[c].dtype.kind == "f":
            sp[c] = sp[c].astype("Int64")
    a, b = digest(sp), digest(dk)
    ok = a[0] == b[0] and a[1] == b[1] and a[2] == b[2]
    detail = ""
    if not ok:
        if a[0] != b[0]:
            detail = f"cols spark={a[0]} duck={b[0]}"
        elif a[1] != b[1]:
            detail = f"rows spark={a[1]} duck={b[1]}"
        else:
            diff = [(x, y) for x, y in zip(a[3], b[3]) if x != y][:3]
            detail = f"values differ, e.g. {diff}"
    return ok, a[1], ts, td, detail


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from shelfcast.session import build_session
    plain = "--plain" in argv
    argv = [a for a in argv if a != "--plain"]
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    if plain:  # a session with default settings, as an outside caller would build it
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            t = time.time()
            try:
                n = len(qs[name](spark, sf_dir).collect())
                print(f"{name:24s} R   rows={n:<8d} spark={time.time() - t:6.2f}s")
            except Exception as e:  # noqa: BLE001
                bad += 1
                print(f"{name:24s} BAD error {type(e).__name__}: {str(e)[:300]}")
            continue
        try:
            ok, n, ts, td, detail = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, n, ts, td, detail = False, -1, 0, 0, f"error {type(e).__name__}: {str(e)[:300]}"
        bad += not ok
        print(f"{name:24s} {'OK ' if ok else 'BAD'} rows={n:<8d} spark={ts:6.2f}s duck={td:5.2f}s {detail}")
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
