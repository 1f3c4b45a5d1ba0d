"""Run registered queries beside their SQL on the same parquet tables and compare the rows.

As a program: `python tests/compare.py <sf_dir> [name prefix ...]`.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return repr(value)
    if isinstance(value, int):
        return repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def same(spark_df, con, sql: str) -> tuple[bool, str]:
    """Whether both give the same columns, types and rows; the message tells the first difference."""
    left = spark_df.toArrow()
    right = con.sql(sql).to_arrow_table()
    if sorted(left.column_names) != sorted(right.column_names):
        return False, f"columns {left.column_names} / {right.column_names}"
    types = {n: (str(left.schema.field(n).type), str(right.schema.field(n).type)) for n in left.column_names}
    note = "".join(f" type {n}: {a}/{b}" for n, (a, b) in types.items() if a.replace("large_", "") != b)
    a = rows_of(left.column_names, zip(*(c.to_pylist() for c in left.columns)))
    b = rows_of(right.column_names, zip(*(c.to_pylist() for c in right.columns)))
    if len(a) != len(b):
        return False, f"rows {len(a)} / {len(b)}{note}"
    differing = [(x, y) for x, y in zip(a, b) if x != y]
    if differing:
        return False, f"{len(differing)} of {len(a)} rows differ, first {differing[0]}{note}"
    return not note, f"{len(a)} rows{note}"


def main(sf_dir: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry
    from cladeflow import get_spark

    spark = get_spark("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                     "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                ok, message = same(df, con, oracles[name])
            else:
                n = df.count()
                ok, message = n > 0, f"{n} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
