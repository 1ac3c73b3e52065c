"""Run queries next to their SQL on the same tables and report differences.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    if value is None:
        return None
    kind = type(value).__name__
    if kind in ("bool", "bool_"):
        return bool(value)
    if "int" in kind:
        return int(value)
    if "float" in kind:
        return None if value != value else float(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(out, key=repr)


def duck(sf):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def compare(spark, connection, sf, name, function, sql):
    start = time.time()
    frame = function(spark, sf)
    names, ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - start
    if sql is None:
        return f"{name}: rows only, {len(ours)} rows, {took:.1f}s", True
    start = time.time()
    relation = connection.sql(sql)
    their_names, theirs = rows_of(relation.columns, relation.fetchall())
    other = time.time() - start
    if names != their_names:
        return f"{name}: COLUMNS {names} <> {their_names}", False
    spark_types = dict(frame.dtypes)
    duck_types = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    pairs = {
        "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
        "boolean": "BOOLEAN", "date": "DATE",
    }
    off = {n: (t, duck_types[n]) for n, t in spark_types.items() if pairs.get(t) != duck_types[n]}
    note = f" TYPES {off}" if off else ""
    if ours != theirs:
        left, right = set(ours), set(theirs)
        a = [r for r in ours if r not in right][:3]
        b = [r for r in theirs if r not in left][:3]
        return f"{name}: DIFFERENT {len(ours)} / {len(theirs)} rows\n  ours {a}\n  sql  {b}{note}", False
    return f"{name}: equal, {len(ours)} rows, {took:.1f}s (sql {other:.1f}s){note}", not off


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    arguments = parser.parse_args()
    from evidgrid.session import build_session

    spark = build_session(
        master="local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
        spark__log__level="ERROR",
    )
    spark.sparkContext.setLogLevel("ERROR")
    from evidgrid.queries import ORACLES, QUERIES

    connection = duck(arguments.sf)
    failures = 0
    for name in arguments.names or list(QUERIES):
        try:
            line, good = compare(
                spark, connection, arguments.sf, name, QUERIES[name], ORACLES.get(name)
            )
        except Exception as error:  # report and go on with the next query
            line, good = f"{name}: FAILED {type(error).__name__} {str(error)[:600]}", False
        failures += not good
        print(line, flush=True)
    print("failures:", failures)


if __name__ == "__main__":
    main()
