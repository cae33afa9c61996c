"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tools/check.py [--sf 0.01] [name prefixes ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from tickloom.plans import load  # noqa: E402
from tickloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        if value == int(value) and abs(value) < 1e15:
            return str(int(value))
        return repr(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return str(value)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--show", type=int, default=3)
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    spark = local_session("check")
    bad = 0
    for name, q in load().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            t0 = time.time()
            df = q.build(spark, sf_dir)
            cols = sorted(df.columns)
            got = sorted(tuple(canonical(r[c]) for c in cols) for r in df.collect())
            t1 = time.time()
        except Exception as e:  # noqa: BLE001 - report and go on
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            continue
        if q.sql is None:
            print(f"rows  {name}: {len(got)} rows, {t1 - t0:.1f}s, no SQL", flush=True)
            continue
        try:
            cur = con.execute(q.sql)
            names = [d[0] for d in cur.description]
            order = [names.index(c) for c in sorted(names)]
            want = sorted(tuple(canonical(r[i]) for i in order) for r in cur.fetchall())
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"SQLERR {name}: {str(e)[:1500]}", flush=True)
            continue
        t2 = time.time()
        if sorted(names) != cols:
            bad += 1
            print(f"COLS  {name}: {cols} vs {sorted(names)}", flush=True)
        elif got != want:
            bad += 1
            only_got = [r for r in got if r not in set(want)]
            only_want = [r for r in want if r not in set(got)]
            print(f"DIFF  {name}: {len(got)} vs {len(want)} rows; {len(only_got)} / {len(only_want)} unmatched {cols}")
            for a, b in list(zip(only_got, only_want))[: args.show] or [(only_got[:3], only_want[:3])]:
                print("   spark ", a, "\n   duckdb", b, flush=True)
        else:
            print(f"ok    {name}: {len(got)} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
