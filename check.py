"""Compare registered queries with their SQL: python check.py [folder] [name ...]."""

from __future__ import annotations

import sys
import time

import duckdb

from textloom.plans import catalog
from textloom.plans.inputs import TABLES
from textloom.session import local_session


def norm(v):
    if v is None or isinstance(v, (str, bool)):
        return repr(v)
    if isinstance(v, float):
        return f"{v:.6g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    return str(v)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    catalog.load_all()
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = catalog.QUERIES[name](spark, folder)
            cols = sorted(df.columns)
            rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
            took = time.time() - start
            if name not in catalog.CHECKS:
                print(f"rows  {name:32} {len(rows):7} rows {took:6.2f}s", flush=True)
                continue
            rel = con.execute(catalog.CHECKS[name])
            heads = [d[0] for d in rel.description]
            order = [heads.index(c) for c in sorted(heads)]
            want = [tuple(norm(r[i]) for i in order) for r in rel.fetchall()]
            same = sorted(heads) == cols and sorted(rows) == sorted(want)
            print(f"{'ok   ' if same else 'DIFF '} {name:32} {len(rows):7} rows {took:6.2f}s", flush=True)
            if not same:
                bad += 1
                print("   columns", cols, sorted(heads), len(rows), len(want))
                a, b = set(rows), set(want)
                print("   spark ", [str(x)[:300] for x in sorted(a - b)[:2]])
                print("   check ", [str(x)[:300] for x in sorted(b - a)[:2]])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name:32} {type(e).__name__}: {str(e)[:900]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
