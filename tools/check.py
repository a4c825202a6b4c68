"""Compare registered queries with their SQL in DuckDB.

usage: python tools/check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plotline.registry import load  # noqa: E402
from plotline.session import local_session  # noqa: E402
from plotline.sources.tables import SCHEMAS  # noqa: E402


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\0"
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and math.isnan(value):
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}"
    if str(value) in ("NaT", "<NA>", "nan"):
        return "\0"
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(canon(v) for v in r) for r in frame.itertuples(index=False, name=None))


def main() -> int:
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at:at + 2]
    folder = f"/root/testdata/sf{sf}"
    db = duckdb.connect()
    for name in SCHEMAS:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, entry in load().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        began = time.time()
        try:
            got = entry.run(spark, folder).toPandas()
        except Exception as error:  # report every query
            bad += 1
            print(f"ERROR {name}: {str(error)[:700]}")
            continue
        took = time.time() - began
        if entry.sql is None:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        began = time.time()
        try:
            want = db.execute(entry.sql).df()
        except Exception as error:
            bad += 1
            print(f"ERROR {name} (sql): {str(error)[:900]}")
            continue
        sql_took = time.time() - began
        if sorted(got.columns) != sorted(want.columns):
            bad += 1
            print(f"FAIL  {name}: columns {sorted(got.columns)} vs {sorted(want.columns)}")
            continue
        a, b = rows(got), rows(want)
        kinds = [f"{c}:{got[c].dtype}/{want[c].dtype}" for c in sorted(got.columns)
                 if got[c].dtype.kind != want[c].dtype.kind]
        if a == b:
            flag = f" kinds {kinds}" if kinds else ""
            empty = " EMPTY" if not a else ""
            print(f"ok    {name}: {len(a)} rows {took:.1f}s sql {sql_took:.1f}s{flag}{empty}",
                  flush=True)
        else:
            bad += 1
            only_a, only_b = set(a) - set(b), set(b) - set(a)
            print(f"FAIL  {name}: {len(a)} vs {len(b)} rows; columns {sorted(got.columns)}")
            for r in sorted(only_a)[:4]:
                print("   spark", r)
            for r in sorted(only_b)[:4]:
                print("   sql  ", r)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
