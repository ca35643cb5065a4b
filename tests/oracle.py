"""Compare a Spark result with its DuckDB counterpart, ignoring row and column order."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd


def norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if os.environ.get("EXACT") else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    if v.__class__.__name__ == "Decimal":
        return norm(float(v))
    return v


def key(row):
    return tuple((x is not None, type(x).__name__ if not isinstance(x, (int, float)) else "n", x) for x in row)


def compare(spark, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    took = time.time() - t0
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=key)
    if sql is None:
        return took, len(got), "rows only"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        t = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{f}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return took, len(got), f"COLUMNS {cols} != {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in idx) for r in cur.fetchall()), key=key)
    if got == want:
        types = [(c, dict(df.dtypes)[c]) for c in cols]
        return took, len(got), "ok"
    diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return took, len(got), f"DIFF {len(got)} != {len(want)} {cols} {diff}"


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from sentrel.plans.queries import ORACLES, QUERIES

    sf = sys.argv[1]
    wanted = sys.argv[2:] or list(QUERIES)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    for n in QUERIES:
        if not any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted):
            continue
        try:
            took, count, verdict = compare(spark, n, QUERIES[n], ORACLES.get(n), f"/root/testdata/{sf}")
            print(f"{n:28s} {took:6.2f}s {count:7d} {verdict[:700]}", flush=True)
        except Exception as e:
            print(f"{n:28s} ERROR {type(e).__name__} {str(e)[:900]}", flush=True)
