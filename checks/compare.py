"""Runs queries and their expected-result SQL side by side: ``python -m checks.compare``."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both give the same columns and rows."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    wanted = _rows(names, result.fetchall())
    wanted_types = {column[0]: str(column[1]) for column in result.description}
    types = {name: TYPES.get(kind, kind) for name, kind in df.dtypes}
    if types != wanted_types:
        return f"columns {sorted(types.items())} instead of {sorted(wanted_types.items())}"
    got = _rows(df.columns, df.collect())
    if got == wanted:
        return None
    extra, lacking = got - wanted, wanted - got
    return (
        f"{got.total()} rows instead of {wanted.total()}; {extra.total()} unexpected, e.g. "
        f"{str(next(iter(extra), None))[:600]}; {lacking.total()} lacking, e.g. "
        f"{str(next(iter(lacking), None))[:600]}"
    )


def main(sf_dir: str, only: list[str]) -> int:
    from checks.queries import EXPECTED, QUERIES
    from plumbline.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name, run in QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in EXPECTED:
                problem = difference(df, connection, EXPECTED[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name:26s} {time.time() - start:6.1f} s  {problem or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
