"""Run every query and its SQL side by side: python tests/check.py [sf] [names...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from tests.session import local_session
from workload.compare import difference
from workload.queries import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                found = difference(df, con.sql(ORACLES[name]))
            else:
                found = None if df.count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:600]}"
            if len(wanted) < 4:
                traceback.print_exc()
        kind = "sql " if name in ORACLES else "rows"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'BAD '} {kind} {time.time() - start:6.2f}s {name} {found or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} equal")


if __name__ == "__main__":
    main()
