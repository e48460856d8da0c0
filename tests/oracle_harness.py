"""Side-by-side check of registered queries against their DuckDB oracle SQL.

Mirrors the driver: row count, column names, and an order-insensitive, exact comparison of values
(doubles compared bit for bit — both sides compute the same exact decimals before the final cast).
Run as a script: ``python tests/oracle_harness.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_rows = [r.asDict() for r in sdf.collect()]
    t1 = time.time()
    d = con.sql(sql)
    d_cols = d.columns
    d_rows = [dict(zip(d_cols, r)) for r in d.fetchall()]
    t2 = time.time()
    s_cols = sdf.columns
    res = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "spark_sec": round(t1 - t0, 2), "oracle_sec": round(t2 - t1, 2)}
    res["columns_match"] = sorted(s_cols) == sorted(d_cols)
    if not res["columns_match"]:
        res["only_spark"] = sorted(set(s_cols) - set(d_cols))
        res["only_oracle"] = sorted(set(d_cols) - set(s_cols))
        res["values_match"] = False
        return res
    cols = sorted(s_cols)
    a, b = rows_of(s_rows, cols), rows_of(d_rows, cols)
    res["values_match"] = a == b
    if not res["values_match"]:
        sa, sb = set(a), set(b)
        diff_a = [x for x in a if x not in sb][:3]
        diff_b = [x for x in b if x not in sa][:3]
        res["example_spark"] = [dict(zip(cols, x)) for x in diff_a]
        res["example_oracle"] = [dict(zip(cols, x)) for x in diff_b]
    return res


def main(argv):
    from tidemark.session import get_spark
    import __spark_entry__ as E
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        if name not in sqls:
            sdf = qs[name](spark, sf_dir)
            print(f"{name}: rows-only {sdf.count()}")
            continue
        try:
            r = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: ERROR {type(e).__name__}: {str(e)[:800]}")
            continue
        ok = r["values_match"] and r["spark_rows"] == r["oracle_rows"]
        bad += not ok
        print(("OK   " if ok else "FAIL ") + str(r)[:3000])
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
