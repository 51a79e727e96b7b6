"""Runs registered queries next to their SQL in DuckDB and reports every difference.

    python check_oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

from evalweave.plans.catalog import BUILDERS, ORACLES
from evalweave.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def sort_key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=sort_key)


KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--data", default="/root/testdata")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"{args.data}/sf{args.sf}"
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "check", f"local[{cores}]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    failed = []
    for name in args.names or BUILDERS:
        started = time.time()
        try:
            frame = BUILDERS[name](spark, sf_dir)
            mine = rows_of(frame.columns, frame.collect())
            took = time.time() - started
            if name not in ORACLES:
                print(f"rows  {name:28s} {len(mine):8d} {took:6.2f}s", flush=True)
                continue
            cursor = con.execute(ORACLES[name])
            heads = [(d[0], str(d[1])) for d in cursor.description]
            theirs = rows_of([h[0] for h in heads], cursor.fetchall())
        except Exception as error:  # noqa: BLE001
            failed.append(name)
            print(f"ERROR {name}: {type(error).__name__}: {str(error)[:1500]}", flush=True)
            continue
        schema = sorted((c, KINDS.get(t, t)) for c, t in frame.dtypes)
        problems = []
        if schema != sorted(heads):
            problems.append(f"schema {set(schema) ^ set(heads)}")
        if len(mine) != len(theirs):
            problems.append(f"rows {len(mine)} != {len(theirs)}")
        elif mine != theirs:
            wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
            problems.append(f"{len(wrong)} rows differ, first {str(wrong[0])[:700]}")
        if problems:
            failed.append(name)
        print(
            f"{'FAIL ' if problems else 'ok   '} {name:28s} {len(mine):8d} {took:6.2f}s {problems or ''}",
            flush=True,
        )
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
