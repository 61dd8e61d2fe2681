"""Runs named queries on Spark and their SQL on DuckDB, and compares the results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

import __spark_entry__ as entry


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(value):
        if value is None or value is pd.NA or (isinstance(value, float) and value != value):
            return "null"
        if isinstance(value, bool):
            return str(value)
        if hasattr(value, "item"):
            value = value.item()
        return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(
            value, bool) else str(value)

    return sorted(tuple(map(cell, row)) for row in frame.itertuples(index=False, name=None))


def disagreement(spark, con, name: str, sf_dir: str) -> str | None:
    mine = entry.queries()[name](spark, sf_dir).toPandas()
    theirs = con.execute(entry.oracle_sql()[name]).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} against {sorted(theirs.columns)}"
    a, b = canonical(mine), canonical(theirs)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{len(a)} against {len(b)} rows; only Spark {only_a}; only SQL {only_b}"


if __name__ == "__main__":
    from placeshare.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    con = connection(sf_dir)
    for name in entry.queries():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            if name in entry.oracle_sql():
                verdict = disagreement(spark, con, name, sf_dir) or "ok"
            else:
                verdict = f"rows {entry.queries()[name](spark, sf_dir).count()}"
        except Exception as error:  # reported per query
            verdict = f"ERROR {type(error).__name__} {str(error)[:600]}"
        print(f"{name:40s} {time.time() - started:6.2f}  {verdict}", flush=True)
