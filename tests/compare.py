"""Runs registered queries against their DuckDB twins (also usable from a shell).

    python tests/compare.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (int, float)):
        return None if math.isnan(value) else float(value) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


def duck_kind(name: str) -> str:
    return {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
            "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
            "HUGEINT": "HUGEINT"}.get(name, name)


def compare(spark, con, folder, query, sql):
    df = query(spark, folder)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(left), []
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    duck = {d[0]: duck_kind(str(d[1])) for d in result.description}
    duck_columns, right = rows_of(names, result.fetchall())
    problems = []
    if columns != duck_columns:
        problems.append(f"columns {columns} != {duck_columns}")
    else:
        for c in columns:
            if kinds[c] != duck[c]:
                problems.append(f"type of {c}: {kinds[c]} != {duck[c]}")
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    elif not problems or columns == duck_columns:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        if bad:
            problems.append(f"{len(bad)} differing rows, e.g. {bad[:2]}")
    return len(left), problems


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = "0.01"
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    folder = f"/root/testdata/sf{sf}"
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    extra = set(oracle) - set(queries)
    if extra:
        print("oracle without query:", extra)
    failed = 0
    for name, query in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            count, problems = compare(spark, con, folder, query, oracle.get(name))
        except Exception as error:  # report and go on
            count, problems = -1, [f"{type(error).__name__}: {str(error)[:700]}"]
        failed += bool(problems)
        mark = "FAIL" if problems else ("ok  " if name in oracle else "rows")
        print(f"{mark} {name} rows={count} {time.time() - start:.1f}s", *problems, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
