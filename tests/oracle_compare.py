"""Run registered Spark queries and their DuckDB SQL side by side; exact compare.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def canon(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, dt.datetime):
        return v.date().isoformat() if v.time() == dt.time(0) else v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    rows = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    return cols, rows


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    rows = sorted(tuple(canon(r[i]) for i in order) for r in data)
    return cols, rows, dict(zip(rel.columns, [str(t) for t in rel.types]))


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir: str, keys=None, verbose=True):
    import importlib
    entry = importlib.import_module("__spark_entry__")
    qs, oracle = entry.queries(), entry.oracle_sql()
    con = duck_connect(sf_dir)
    results = {}
    for k in keys or list(qs):
        if k not in oracle:
            continue
        t0 = time.time()
        try:
            sdf = qs[k](spark, sf_dir)
            scols, srows = spark_rows(sdf)
            stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
            dcols, drows, dtypes = duck_rows(con, oracle[k])
        except Exception as e:  # noqa: BLE001
            results[k] = f"ERROR {type(e).__name__}: {str(e)[:400]}"
            if verbose:
                print(k, results[k], flush=True)
            continue
        if scols != dcols:
            msg = f"COLUMNS spark={scols} duck={dcols}"
        elif len(srows) != len(drows):
            msg = f"ROWCOUNT spark={len(srows)} duck={len(drows)}"
        elif srows != drows:
            diff = [(a, b) for a, b in zip(srows, drows) if a != b][:2]
            msg = f"VALUES differ ({sum(a != b for a, b in zip(srows, drows))} rows) e.g. {diff}"
        else:
            msg = "OK"
        results[k] = msg
        if verbose:
            print(f"{k:28s} {time.time() - t0:6.2f}s rows={len(srows):6d} {msg[:600]}", flush=True)
            if msg == "OK":
                tdiff = {c: (stypes[c], dtypes.get(c)) for c in scols}
                print("    types:", {c: v for c, v in tdiff.items()}, flush=True) if os.environ.get("SHOW_TYPES") else None
    return results


if __name__ == "__main__":
    from storelens.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = build_session("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, keys)
    bad = {k: v for k, v in res.items() if v != "OK"}
    print(f"\n{len(res) - len(bad)}/{len(res)} OK")
    for k, v in bad.items():
        print("  FAIL", k, v[:300])
