"""Compare registered queries with their checking SQL on DuckDB.

    python tests/check_oracle.py [-d SF_DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import glob
import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return v.date() if v.time() == datetime.time() else v
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


SPARK_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def compare(name, fn, sql, spark, con, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return f"rows  {name}: {len(got)} rows {took:.1f}s", True
    start = time.time()
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = con.fetchall()
    duck_took = time.time() - start
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    mine, left = rows_of(df.columns, [tuple(r) for r in got])
    theirs, right = rows_of(names, want)
    if mine != theirs:
        return f"COLS  {name}: {mine} vs {theirs}", False
    types = [
        (c, t, kinds[c]) for c, t in df.dtypes if SPARK_KINDS.get(t, t.upper()) != kinds[c] and t in SPARK_KINDS
    ]
    if types:
        return f"TYPES {name}: {types}", False
    if len(left) != len(right):
        return f"COUNT {name}: {len(left)} vs {len(right)}", False
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        detail = "\n".join(f"   spark {a}\n   duck  {b}" for a, b in bad[:3])
        return f"VALUE {name}: {len(bad)} of {len(left)} rows\n{detail[:1500]}", False
    return f"ok    {name}: {len(left)} rows spark {took:.1f}s duck {duck_took:.1f}s", True


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file:{tempfile.mkdtemp(prefix='tillsight-shared-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("-d", default="/root/testdata/sf0.01")
    parser.add_argument("-c", action="store_true", help="only queries that have checking SQL")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry

    queries, checks = entry.queries(), entry.oracle_sql()
    spark, con = session(), duck(args.d)
    good = total = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        if args.c and name not in checks:
            continue
        total += 1
        try:
            line, ok = compare(name, fn, checks.get(name), spark, con, args.d)
        except Exception as e:  # noqa: BLE001
            line, ok = f"ERROR {name}: {str(e)[:500]}", False
        good += ok
        print(line, flush=True)
    print(f"{good} of {total} good")
    spark.stop()


if __name__ == "__main__":
    main()
