"""Compare registered queries with their DuckDB twins.

    python tests/oracle.py [--sf sf0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cpus: int = 8):
    import tempfile

    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("hydroseries")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if hasattr(v, "hour") and (v.hour, v.minute, v.second) == (0, 0, 0) else v.isoformat()
    return repr(v)


def compare(spark, con, name: str, sf: str) -> tuple[bool, str]:
    df = entry.queries()[name](spark, f"{DATA}/{sf}")
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {len(got)}"
    res = con.execute(sql)
    have = [c[0] for c in res.description]
    if sorted(have) != cols:
        return False, f"columns {cols} vs {sorted(have)}"
    rows = [dict(zip(have, r)) for r in res.fetchall()]
    want = sorted(tuple(canon(r[c]) for c in cols) for r in rows)
    if got == want:
        return True, f"{len(got)} rows"
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    return False, f"{len(got)} vs {len(want)} rows, {len(diff)} differ; cols {cols}; first {diff[:2]}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="sf0.01")
    a = ap.parse_args()
    spark, con = session(), duck(a.sf)
    bad = 0
    for name in entry.queries():
        if a.names and not any(name.startswith(p) for p in a.names):
            continue
        t = time.time()
        try:
            ok, text = compare(spark, con, name, a.sf)
        except Exception as e:  # noqa: BLE001
            ok, text = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {text}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
