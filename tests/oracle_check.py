"""Compare registered Spark queries with their DuckDB text on the same tables.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Also used by tests/test_oracle.py.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or type(v).__name__ == "NAType":
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(pdf) -> list:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, key: str, sf_dir: str) -> tuple[bool, str]:
    from couplemap.plans.registry import QUERIES, SQL

    t = time.time()
    sdf = QUERIES[key](spark, sf_dir).toPandas()
    ts = time.time() - t
    t = time.time()
    ddf = con.execute(SQL[key]).df()
    td = time.time() - t
    if sorted(sdf.columns) != sorted(ddf.columns):
        return False, f"columns {sorted(sdf.columns)} != {sorted(ddf.columns)}"
    if len(sdf) != len(ddf):
        return False, f"rows {len(sdf)} != {len(ddf)}"
    a, b = rows_of(sdf), rows_of(ddf)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. {bad[:2]}"
    return True, f"{len(sdf)} rows, spark {ts:.1f}s duckdb {td:.1f}s"


def main():
    from couplemap.plans.registry import SQL
    from couplemap.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or sorted(SQL)
    spark = local_session()
    con = duck(sf_dir)
    fails = 0
    for k in keys:
        try:
            ok, msg = compare(spark, con, k, sf_dir)
        except Exception as e:  # report and go on
            ok, msg = False, f"error {type(e).__name__}: {str(e)[:300]}"
        fails += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {k}: {msg}", flush=True)
    print(f"{len(keys) - fails}/{len(keys)} equal")


if __name__ == "__main__":
    main()
