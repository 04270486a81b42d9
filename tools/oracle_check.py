"""Run bound queries in Spark and their SQL twins in DuckDB; compare results.

Usage: python tools/oracle_check.py [--sf DIR] [name-substring ...]

Compares column names, column type classes, row counts and the multiset of
rows (columns sorted by name, doubles rounded to 6 digits).
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fieldcounts.plans.catalog import load_all  # noqa: E402
from fieldcounts.session import local_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def spark_class(dtype) -> str:
    n = dtype.typeName()
    return {"integer": "int32", "long": "int64", "short": "int16", "byte": "int8", "double": "float64",
            "float": "float32", "string": "str", "date": "date", "boolean": "bool",
            "timestamp": "ts", "timestamp_ntz": "ts"}.get(n, n)


def duck_class(t) -> str:
    s = str(t).upper()
    if s.startswith("DECIMAL"):
        return "decimal"
    return {"INTEGER": "int32", "BIGINT": "int64", "SMALLINT": "int16", "TINYINT": "int8",
            "DOUBLE": "float64", "FLOAT": "float32", "VARCHAR": "str", "DATE": "date",
            "BOOLEAN": "bool", "TIMESTAMP": "ts", "HUGEINT": "int128"}.get(s, s.lower())


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    reg = load_all()
    names = [n for n in reg if not args.names or any(s in n for s in args.names)]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    bad = 0
    for name in names:
        q = reg[name]
        t0 = time.time()
        try:
            sdf = q.build(spark, args.sf)
            srows = sdf.collect()
            scols = sdf.columns
            stypes = {f.name: spark_class(f.dataType) for f in sdf.schema.fields}
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if not q.sql:
            print(f"NOSQL {name}: rows={len(srows)} spark={ts:.2f}s")
            continue
        try:
            rel = con.sql(q.sql)
            dcols = rel.columns
            dtypes = {c: duck_class(t) for c, t in zip(rel.columns, rel.types)}
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        problems = []
        if sorted(scols) != sorted(dcols):
            problems.append(f"columns spark={sorted(scols)} duck={sorted(dcols)}")
        else:
            tm = {c: (stypes[c], dtypes[c]) for c in scols if stypes[c] != dtypes[c]}
            if tm:
                problems.append(f"types {tm}")
            order = sorted(scols)
            si = [scols.index(c) for c in order]
            di = [dcols.index(c) for c in order]
            sc = Counter(tuple(norm(r[i]) for i in si) for r in srows)
            dc = Counter(tuple(norm(r[i]) for i in di) for r in drows)
            if len(srows) != len(drows):
                problems.append(f"rows spark={len(srows)} duck={len(drows)}")
            if sc != dc:
                only_s = list((sc - dc).elements())[:3]
                only_d = list((dc - sc).elements())[:3]
                problems.append(f"values differ ({sum((sc - dc).values())} rows); order={order}\n"
                                f"   spark-only {only_s}\n   duck-only  {only_d}")
        if problems:
            bad += 1
            print(f"FAIL {name}: rows={len(srows)} " + "; ".join(problems))
        else:
            print(f"OK   {name}: rows={len(srows)} spark={ts:.2f}s")
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
