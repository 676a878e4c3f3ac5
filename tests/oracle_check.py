"""Runs every registered query and its SQL on the same tables and compares."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return f"{value:.6f}"
    return value if isinstance(value, (bool, str)) else str(value)


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: [(v is None, str(v)) for v in row])


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None if both results are the same, else what is different."""
    df = query(spark, sf_dir)
    ours = table(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = table(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(names) ^ set(df.columns))}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, not {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} of {len(ours)} rows, e.g. {wrong[0]}" if wrong else None


if __name__ == "__main__":
    import __spark_entry__ as e
    from ronda.session import local_session

    directory, wanted = sys.argv[1], sys.argv[2:]
    session = local_session("oracle")
    duck = oracle_connection(directory)
    sqls = e.oracle_sql()
    for key, run in e.queries().items():
        if wanted and key not in wanted:
            continue
        began = time.time()
        try:
            verdict = compare(session, duck, key, run, sqls[key], directory)
        except Exception as error:  # report and go on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:500]}"
        print(f"{key:28s} {verdict or 'same'}  {time.time() - began:.1f}s", flush=True)
