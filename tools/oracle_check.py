"""Run registered Spark queries and their DuckDB oracles side by side.

usage: python tools/oracle_check.py [sf_dir] [key-prefix ...]
Compares row count, column names and an order-insensitive value hash.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

sys.path.insert(0, ".")
from tidemark.plans import catalog  # noqa: E402
from tidemark.session import local_session  # noqa: E402
from tidemark.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6))
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_mismatches(df, description):
    duck = {d[0]: str(d[1]) for d in description}
    out = {}
    for f in df.schema.fields:
        s = SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
        if duck.get(f.name) != s:
            out[f.name] = (s, duck.get(f.name))
    return out


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for key, fn in qs.items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {key}: spark error {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if key not in sqls:
            print(f"rows-only {key}: {len(srows)} rows {ts:.1f}s")
            continue
        try:
            res = con.execute(sqls[key])
            drows = res.fetchall()
            dcols = [d[0] for d in res.description]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {key}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        hs, ls = digest(srows, scols)
        hd, ld = digest(drows, dcols)
        types = type_mismatches(df, res.description)
        ok = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and hs == hd and not types
        if types:
            print(f"   type mismatches {key}: {types}")
        if ok:
            print(f"ok   {key}: {len(srows)} rows {ts:.1f}s")
        else:
            bad += 1
            print(f"FAIL {key}: spark {len(srows)} rows {sorted(scols)} | duck {len(drows)} rows {sorted(dcols)}")
            diff_s = [x for x in ls if x not in set(ld)][:3]
            diff_d = [x for x in ld if x not in set(ls)][:3]
            print("   spark-only:", diff_s)
            print("   duck-only: ", diff_d)
    print(f"{bad} failures")


if __name__ == "__main__":
    main()
