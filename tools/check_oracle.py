"""Run registered queries on Spark and their SQL oracles on DuckDB; compare results.

Usage: python tools/check_oracle.py [--sf DIR] [name ...]
Mirrors the driver's check: same column names, same row count, same multiset
of rows (floats compared after rounding to 6 places).
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from roomcast.plans.registry import oracles, queries  # noqa: E402
from roomcast.session import get_spark  # noqa: E402
from roomcast.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "dtype") and getattr(v, "ndim", 1) == 0:
        try:
            f = float(v)
        except (TypeError, ValueError):
            return v
        if math.isnan(f):
            return None
        f = round(f, 6) + 0.0
        return int(f) if f.is_integer() else f
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = Counter()
    for rec in pdf[cols].itertuples(index=False, name=None):
        out[tuple(_norm(x) for x in rec)] += 1
    return cols, out


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    qs, os_ = queries(), oracles()
    names = args.names or sorted(qs)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = qs[name](spark, args.sf)
            spd = sdf.toPandas()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in os_:
            print(f"ROWS {name}: {len(spd)} rows (no oracle) spark {ts:.1f}s")
            continue
        t1 = time.time()
        try:
            dpd = con.execute(os_[name]).df()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(exc)[:400]}")
            bad += 1
            continue
        td = time.time() - t1
        sc, sr = _rows(spd)
        dc, dr = _rows(dpd)
        if sc != dc:
            print(f"FAIL {name}: columns spark={sc} duckdb={dc}")
            bad += 1
            continue
        if sr != dr:
            only_s = list((sr - dr).items())[:3]
            only_d = list((dr - sr).items())[:3]
            print(f"FAIL {name}: rows spark={len(spd)} duckdb={len(dpd)}; spark-only {only_s}; duckdb-only {only_d}")
            bad += 1
            continue
        print(f"OK   {name}: {len(spd)} rows  spark {ts:.1f}s duckdb {td:.1f}s  types {dict(zip(sdf.columns, [f.dataType.simpleString() for f in sdf.schema]))} | {dict(zip(dpd.columns, map(str, dpd.dtypes)))}"[:300])
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
