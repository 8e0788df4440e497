"""Runs registered queries next to their SQL; also usable from the command line."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> str:
    """Empty text if both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    left_cols, left = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if left else "no rows"
    cur = con.execute(sql)
    right_cols, right = _rows([d[0] for d in cur.description], cur.fetchall())
    if left_cols != right_cols:
        return f"columns differ: {sorted(set(left_cols) ^ set(right_cols))}"
    if len(left) != len(right):
        return f"rows differ: {len(left)} and {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            gap = [(c, x, y) for c, x, y in zip(left_cols, a, b) if x != y]
            return f"values differ: {gap[:4]} in {a[:6]}"
    return "" if left else "no rows on either side"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from cadastra.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, fn, entry.oracle_sql().get(name), sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'ok ' if not problem else 'BAD'} {kind:4} {time.time() - start:6.2f}s {name} {problem}", flush=True)
