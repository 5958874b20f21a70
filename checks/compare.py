"""Run queries on Spark and their SQL on DuckDB, and compare whole results.

``python -m checks.compare [sf_dir] [query ...]``
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

from checks.oracles import ORACLES
from checks.queries import QUERIES
from registryloom.session import session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _cell(v: object) -> object:
    return None if isinstance(v, float) and math.isnan(v) else v


def as_bag(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty text if both results hold the same rows under the same names and types."""
    cursor = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cursor.description}
    names, theirs = list(types), cursor.fetchall()
    ours = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = as_bag(df.columns, ours), as_bag(names, theirs)
    if a != b:
        extra, missing = list((a - b).items())[:2], list((b - a).items())[:2]
        return f"{len(ours)} rows against {len(theirs)}; only ours {extra}, only theirs {missing}"
    kinds = {
        "string": "VARCHAR",
        "bigint": "BIGINT",
        "int": "INTEGER",
        "date": "DATE",
        "boolean": "BOOLEAN",
        "double": "DOUBLE",
    }
    off = {n: (t, types[n]) for n, t in df.dtypes if kinds.get(t, t) != types[n]}
    return f"types differ: {off}" if off else ""


def main(sf_dir: str = "/root/testdata/sf0.01", *only: str) -> int:
    spark = session(
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": 8,
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in only or QUERIES:
        begin = time.time()
        try:
            found = differences(QUERIES[name](spark, sf_dir), con, ORACLES[name])
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {error}"
        failed += bool(found)
        took = f"{time.time() - begin:6.2f}s"
        print("FAIL" if found else "ok  ", f"{name:26s}", took, found[:1500], flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
