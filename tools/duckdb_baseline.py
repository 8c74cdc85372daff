"""Time every oracle SQL on DuckDB (single node) at one scale factor.

usage: python tools/duckdb_baseline.py [sf_dir]  -> one JSON line
A single-node reference point only: round-trip oracles read the answer
from columns instead of parsing text, so they do less work than the
Spark job they check.
"""

from __future__ import annotations

import json
import os
import sys
import time

import duckdb

sys.path.insert(0, ".")
from ledgerlens.plans.oracles import ORACLES  # noqa: E402
from ledgerlens.sources.tables import TABLES  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"SET threads TO {int(os.environ.get('BENCH_CPUS', '8'))}")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    times = {}
    for name, sql in ORACLES.items():
        t0 = time.perf_counter()
        con.execute(f"SELECT COUNT(*) FROM ({sql}) q").fetchall()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"engine": f"duckdb {duckdb.__version__}", "sf": sf, "total_sec": round(sum(times.values()), 3),
                      "queries": times}))


if __name__ == "__main__":
    main()
