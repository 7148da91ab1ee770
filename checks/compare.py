"""Run registered queries next to their check SQL and compare the results.

    python -m checks.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import glob
import math
import os
import time

import duckdb
from pyspark.sql import SparkSession

from checks.queries import ORACLE_SQL
from milaan.plans.registry import QUERIES


def local_session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else round(float(value), 6)
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def type_notes(frame, description) -> list[str]:
    """Columns whose type differs between the two engines (values are compared as numbers either way)."""
    sql = {d[0]: str(d[1]) for d in description}
    return [f"{n}: {t}/{sql.get(n)}" for n, t in frame.dtypes if TYPES.get(t) != sql.get(n)]


def differences(spark: SparkSession, con, name: str, sf_dir: str) -> tuple[str | None, float, int]:
    started = time.time()
    frame = QUERIES[name](spark, sf_dir)
    got_columns, got = frame.columns, frame.collect()
    spent = time.time() - started
    if name not in ORACLE_SQL:
        return None, spent, len(got)
    cursor = con.execute(ORACLE_SQL[name])
    want_columns = [d[0] for d in cursor.description]
    notes = type_notes(frame, cursor.description)
    if notes:
        print(f"     {name} types {notes}", flush=True)
    want = cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(set(got_columns) ^ set(want_columns))}", spent, len(got)
    a, b = rows_of(got_columns, got), rows_of(want_columns, want)
    if a == b:
        return None, spent, len(a)
    extra, lacking = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
    return f"{len(a)} vs {len(b)} rows; {sorted(got_columns)}\n   only Spark {extra[:3]}\n   only SQL   {lacking[:3]} ({len(extra)}/{len(lacking)})", spent, len(a)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        table = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = local_session(), connect(args.sf)
    bad = 0
    for name in args.names or QUERIES:
        try:
            problem, spent, n = differences(spark, con, name, args.sf)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, spent, n = f"{type(error).__name__}: {str(error)[:900]}", 0.0, 0
        bad += problem is not None
        kind = "ok" if problem is None else "DIFF"
        print(f"{kind:5}{name:28}{n:8} rows {spent:6.1f}s {'' if name in ORACLE_SQL else '(rows only)'} {problem or ''}", flush=True)
    print(f"{bad} of {len(args.names or QUERIES)} differ")


if __name__ == "__main__":
    main()
