"""Time every oracle SQL in DuckDB (single process, all cores) at one scale
factor, fully materialising each result into a temporary table.

Usage: python scripts/duckdb_baseline.py [sf_dir]   -> one JSON line
"""

from __future__ import annotations

import json
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from shopframe.plans.oracle import oracle_sql  # noqa: E402
from shopframe.sources.shop_tables import TEST_TABLES  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    times = {}
    for i, (name, sql) in enumerate(oracle_sql().items()):
        best = None
        for _ in range(2):
            t0 = time.perf_counter()
            con.execute(f"CREATE OR REPLACE TEMP TABLE _r{i} AS {sql}")
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 4)
    print(json.dumps({"engine": "duckdb", "value": round(sum(times.values()), 4), "unit": "sec",
                      "queries": times, "sf_dir": sf_dir}))


if __name__ == "__main__":
    main(sys.argv)
