"""Run queries against their oracle SQL and compare columns, types and rows."""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from platwork.plans.standins import TABLES  # noqa: E402

TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    return round(value, 9) if isinstance(value, float) else value


def _rows(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, query, sql: str, folder: str) -> tuple[str | None, int, float, float]:
    """(problem or None, rows, Spark seconds, oracle seconds)."""
    start = time.time()
    df = query(spark, folder)
    mine = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    oracle = time.time() - start
    kinds = dict(zip(names, (r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall())))
    problem = None
    if sorted(df.columns) != sorted(names):
        problem = f"columns {sorted(df.columns)} != {sorted(names)}"
    elif any(TYPES.get(t, t) != kinds[c] for c, t in df.dtypes):
        problem = "types " + str([(c, t, kinds[c]) for c, t in df.dtypes if TYPES.get(t, t) != kinds[c]])
    elif len(mine) != len(theirs):
        problem = f"{len(mine)} rows != {len(theirs)}"
    else:
        a, b = _rows(mine, df.columns), _rows(theirs, names)
        different = [(x, y) for x, y in zip(a, b) if x != y]
        if different:
            problem = f"{len(different)} rows differ, first {different[0]} (columns {sorted(names)})"
    return problem, len(mine), spent, oracle


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from platwork.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(folder), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if only and name not in only:
            continue
        try:
            problem, n, spent, oracle = compare(spark, con, name, query, oracles[name], folder)
        except Exception as error:  # shown, then the next query runs
            problem, n, spent, oracle = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0.0, 0.0
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} rows={n:<7d} spark={spent:6.2f}s oracle={oracle:5.2f}s {problem or ''}", flush=True)
    print(f"{bad} failing")
